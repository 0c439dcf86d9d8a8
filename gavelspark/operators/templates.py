"""Prompt and answer templates; the wording is fixed by the behaviour to be matched."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gavelspark.functions import patterns as P
from gavelspark.functions import text as X

# Fixed values -------------------------------------------------------------------------------------------------------
VOTE_FORMAT = "Provide your assessment in this exact format:\nVERDICT: [TRUE/FALSE]\nCONFIDENCE: [0-100]\nEXPLANATION: [Short explanation grounded in the evidence]\nCORRECTION: [If false, provide the corrected information; otherwise N/A]"
GOLD_FORMAT = "Provide your answer in this exact format:\nVERDICT: [TRUE/FALSE]\nCONFIDENCE: [0-100]\nEXPLANATION: [Short evidence-grounded explanation]\nCORRECTION: [If false, give the correct fact; otherwise N/A]"
SILVER_FORMAT = "Provide your answer in this exact format:\nVERDICT: [TRUE/MOSTLY-TRUE/HALF-TRUE/BARELY-TRUE/FALSE/PANTS-FIRE]\nCONFIDENCE: [0-100]\nEXPLANATION: [Short evidence-grounded explanation]\nCORRECTION: [Short correction or N/A]"
API_FORMAT = "Provide your assessment in this exact format:\nVERDICT: [TRUE/FALSE/MISLEADING/UNVERIFIED/NEEDS_CONTEXT]\nCONFIDENCE: [0-100]\nEXPLANATION: [Detailed explanation with evidence]\nCORRECTION: [If false or misleading, provide the correct information]"
ANALYZE = "Analyze this claim from Canadian Parliament and provide a fact-check:"
ANALYZE_SILVER = "Analyze this political claim from Canadian Parliament and provide a fact-check."
ANALYZE_PLAIN = "Fact-check the following claim made in Canadian Parliament:"
ASK_PLAIN = "Is this claim accurate? Provide evidence and explanation."
#: Captions of the fields of prompts and answers, with what stands for a missing value.
CLAIM, SPEAKER, DATE, BILL, PARTY, VOTE_DATE = '\n\nClaim: "', '"\nSpeaker: ', "\nDate: ", "\nBill: ", "\nNamed party: ", "\nVote date: "
VERDICT, CONFIDENCE, EXPLANATION, CORRECTION = "VERDICT: ", "\nCONFIDENCE: ", "\nEXPLANATION: ", "\nCORRECTION: "
PROVENANCE = ("Claim type: ", "\nBill: ", "\nBill session: ", "\nSource statement id: ", "\nEvidence ids: ")
SILVER_CAPTIONS = ("\nClaim type: ", "\nLocal context: ", "\nEvidence: ")
UNKNOWN, NOT_APPLICABLE, GENERAL_TOPIC, NO_SOURCE, MEDIUM, NO_EXPLANATION = "Unknown", "N/A", "General Debate", "No source provided", "Medium", "No explanation generated"
PLAIN_ANSWER = ("Verification: ", "\n\nEvidence: ", "\n\nExplanation: ", "\n\nConfidence: ")
QUESTION = ("The ", " voted ", ' on the House vote question "', '" on ', ".")
#: Greatest lengths of a vote's question, of explanations and corrections of gold and silver rows, and of contexts.
QUESTION_LIMIT, GOLD_LIMITS, SILVER_LIMITS, API_CONTEXT, PLAIN_CONTEXT = 220, (300, 240), (260, 220), 300, 500
# --------------------------------------------------------------------------------------------------------------------


def _lines(*parts: Column | str) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _answer(confidence: Column | str, explanation: Column, correction: Column) -> Column:
    return _lines(VERDICT, F.upper(X.or_empty("label")), CONFIDENCE, confidence, EXPLANATION, explanation, CORRECTION, correction)


def _opening() -> list[Column | str]:
    return [CLAIM, X.or_empty("claim_text"), SPEAKER, X.or_else("source_speaker", UNKNOWN), DATE, X.or_else("source_date", UNKNOWN)]


def vote_prompt() -> Column:
    """Prompt of a vote claim from a master row."""
    c = X.or_empty
    return _lines(ANALYZE, *_opening(), BILL, c("bill_number"), PARTY, c("party_name"), VOTE_DATE, c("vote_date"), "\n\nContext: ", c("source_context_local"), "\n\nEvidence: ", c("evidence_text"), "\n\n", VOTE_FORMAT)


def vote_completion() -> Column:
    """Answer of a vote claim from a master row."""
    question = X.trim_words(X.or_else("votequestion_description", F.concat(F.lit("Vote on Bill "), X.or_empty("bill_number"))), QUESTION_LIMIT)
    the, voted, on, at, end = QUESTION
    recorded = _lines(the, X.or_empty("party_name"), voted, X.or_empty("evidence_vote_direction"), on, question, at, X.or_empty("vote_date"), end)
    return _answer("100", X.or_empty("explanation"), F.when(F.col("label") == "True", NOT_APPLICABLE).otherwise(recorded))


def gold_prompt() -> Column:
    """Prompt of a gold row."""
    na = lambda c: X.or_else(c, NOT_APPLICABLE)
    values = (F.coalesce("claim_type", F.lit("unknown")), na("bill_number"), na("session_id"), na("source_statement_id"), na("evidence_primary_ids"))
    source = [x for pair in zip(PROVENANCE, values, strict=True) for x in pair]
    return _lines(ANALYZE, *_opening(), "\nContext: ", X.or_else("source_context_local", F.col("source_context"), NOT_APPLICABLE), "\nEvidence: ", na("evidence_text"), "\nProvenance:\n", *source, "\n\n", GOLD_FORMAT)


def gold_completion() -> Column:
    """Answer of a gold row."""
    most, most_correction = GOLD_LIMITS
    correction = F.when(F.col("label") == "True", NOT_APPLICABLE).otherwise(X.trim_hard(X.or_else("evidence_text", X.or_empty("explanation")), most_correction))
    return _answer("100", X.trim_hard("explanation", most), F.coalesce(correction, F.lit("")))


def silver_prompt(instructions: str = SILVER_FORMAT) -> Column:
    """Prompt of a silver row; ``instructions`` is the answer format."""
    values = (X.or_else("claim_type", "general"), X.or_else("source_context_local", F.col("source_context"), NOT_APPLICABLE), X.or_else("evidence_text", NOT_APPLICABLE))
    fields = [x for pair in zip(SILVER_CAPTIONS, values, strict=True) for x in pair]
    return _lines(ANALYZE_SILVER, *_opening(), *fields, "\n\n", instructions)


def silver_completion() -> Column:
    """Answer of a silver row."""
    most, most_correction = SILVER_LIMITS
    correction = F.when(F.col("label").isin(*P.CORRECTED_LABELS), X.trim_hard("evidence_text", most_correction)).otherwise(NOT_APPLICABLE)
    return _answer(X.or_else("label_confidence", NOT_APPLICABLE), X.trim_hard("label_rationale", most), correction)


def api_prompt(claim: str, speaker: str, day: str, context: str) -> Column:
    """Prompt of a served request; a line stays empty where its field is absent."""
    line = lambda name, c, value: F.when(X.or_empty(c) != "", F.concat(F.lit(f"{name}: "), value)).otherwise("")
    cut_short = F.concat(F.substring(context, 1, API_CONTEXT), F.lit("..."))
    return _lines(ANALYZE, CLAIM, X.or_empty(claim), '"\n', line("Speaker", speaker, F.col(speaker)), "\n", line("Date", day, F.col(day)), "\n", line("Context", context, cut_short), "\n\n", API_FORMAT)


def plain_pair() -> tuple[Column, Column]:
    """Prompt and answer of the oldest form, from a labelled claim."""
    prompt = _lines(
        ANALYZE_PLAIN, CLAIM, F.col("claim_text"), SPEAKER, F.col("speaker_name"), " (", F.coalesce("party", F.lit(UNKNOWN)), ")", DATE, F.col("debate_date").cast("string"),
        "\nTopic: ", F.coalesce("topic", F.lit(GENERAL_TOPIC)), "\n\nContext: ", F.substring("full_context", 1, PLAIN_CONTEXT), "...\n\n", ASK_PLAIN,
    )
    values = (F.col("verification_status"), F.coalesce("evidence_source", F.lit(NO_SOURCE)), F.col("explanation"), F.coalesce("confidence_score", F.lit(MEDIUM)))
    return prompt, _lines(*[x for pair in zip(PLAIN_ANSWER, values, strict=True) for x in pair])


def api_fields(answer: Column | str) -> dict[str, Column]:
    """Verdict, confidence, explanation and correction of an answer, null where absent; confidence as a share."""
    t = X._col(answer)
    return {
        "verdict": F.coalesce(F.upper(X.extract(t, P.VERDICT_API)), F.lit("UNVERIFIED")),
        "confidence": F.coalesce(X.extract(t, P.API_CONFIDENCE).try_cast("double"), F.lit(50.0)) / 100,
        "explanation": F.coalesce(X.strip(X.extract(t, P.API_EXPLANATION)), F.lit(NO_EXPLANATION)),
        "correction": X.strip(X.extract(t, P.API_CORRECTION)),
    }


#: Own wording; only the answer's fields and labels are fixed by the parser that reads them.
LABELLING = """Label this parliamentary claim with the context below and, where needed, official Canadian sources. Refuse it if the evidence does not carry a label.

Answer with one JSON object and nothing else:
{"accept": true or false, "label": one of %s, "confidence": 0 to 100, "not_binary_reason": text, "rationale": text, "evidence_summary": text, "used_sources": [{"title", "url", "source_type", "why_relevant"}], "reason": text if refused}

A label between true and false needs a not_binary_reason. Choose it where the claim is right in part: mostly-true for a minor slip, half-true where much speaks for and against it, barely-true where only a small part holds."""


def labelling_prompt(instructions: str = LABELLING % ", ".join(P.SILVER_LABELS)) -> Column:
    """Prompt that asks for a label of a candidate: instructions, claim, both contexts and what is known of the source."""
    topic = F.coalesce(F.nullif(F.col("h2_en"), F.lit("")), F.nullif(F.col("h1_en"), F.lit("")), F.lit("Unknown"))
    source = _lines("Speaker: ", X.or_else("speaker", "Unknown"), "\nDate: ", X.or_else("date", "Unknown"), "\nTopic: ", topic)
    return _lines(instructions, "\n\nClaim:\n", X.or_empty("claim_text"), "\n\nLocal context:\n", X.or_empty("source_context_local"), "\n\nFull context:\n", X.or_empty("full_context"), "\n\nSource:\n", source)
