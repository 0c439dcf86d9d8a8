"""Queries of the claim-verification operators on the test tables, over whole tables, with their SQL.

The test tables have no document, session or party-alias tables: documents and sessions are read off the statements and
bills, and the parties' own names serve as aliases.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavelspark.functions import patterns as P
from gavelspark.functions import text as X
from gavelspark.functions import values as V
from gavelspark.operators import boundaries, gold, merge, metrics, ranking, records, retrieval, sampling, silver, templates, votes
from gavelspark.plans import pipelines
from gavelspark.session import cut, table
from gavelspark.sources import readers

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query with the SQL that gives the same rows."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# Relations ----------------------------------------------------------------------------------------------------------


def statements(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Current statements with the columns that a query needs; others are neither read nor shuffled."""
    return records.current(table(spark, d, "hansards_statement").select("id", "loaded_at", *columns))


def bills(spark: SparkSession, d: str) -> DataFrame:
    return records.current(table(spark, d, "bills_bill"), deletable=True)


def parties(spark: SparkSession, d: str) -> DataFrame:
    return records.current(table(spark, d, "core_party"), deletable=True)


def sessions(spark: SparkSession, d: str) -> DataFrame:
    part = F.split("session_id", "-")
    return table(spark, d, "bills_bill").where("session_id is not null").select(F.col("session_id").alias("id"), F.try_element_at(part, F.lit(1)).try_cast("int").alias("parliamentnum"), F.try_element_at(part, F.lit(2)).try_cast("int").alias("sessnum")).distinct()


def documents_of(rows: DataFrame) -> DataFrame:
    return rows.where("document_id is not null").groupBy(F.col("document_id").alias("id")).agg(F.min(F.to_date("time")).alias("date"))


_ST = """
st AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) AS rn_ FROM hansards_statement WHERE id IS NOT NULL) WHERE rn_ = 1)"""
_BI = """
bi AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) AS rn_ FROM bills_bill WHERE id IS NOT NULL) WHERE rn_ = 1 AND deleted_at IS NULL)"""
_PA = """
pa AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) AS rn_ FROM core_party WHERE id IS NOT NULL) WHERE rn_ = 1 AND deleted_at IS NULL)"""
_VQ = """
vq AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) AS rn_ FROM bills_votequestion WHERE id IS NOT NULL) WHERE rn_ = 1)"""
_PV = """
pv AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) AS rn_ FROM bills_partyvote WHERE id IS NOT NULL) WHERE rn_ = 1)"""


def _squeeze(x: str) -> str:
    """White space collapsed and stripped, no-break and other Unicode spaces included, as SQL."""
    return f"trim(regexp_replace({x}, '[\\s\\p{{Z}}\\x{{0085}}\\x1c-\\x1f\\x0b]+', ' ', 'g'))"


def _or_empty(x: str) -> str:
    return f"coalesce({x}, '')"


def _any(x: str, family) -> str:
    return "(" + " OR ".join(f"regexp_matches({x}, {_lit(p)})" for p in family) + ")"


def _lit(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _stripped(x: str) -> str:
    return f"regexp_replace({x}, '^[\\s\\p{{Z}}\\x{{0085}}\\x1c-\\x1f\\x0b]+|[\\s\\p{{Z}}\\x{{0085}}\\x1c-\\x1f\\x0b]+$', '', 'g')"


def _parted(x: str) -> str:
    """Parts after a terminator and white space, as SQL, which has no lookbehind."""
    return f"string_split(regexp_replace({x}, '([.!?])[ \\t\\n\\x0b\\f\\r]+', '\\1' || chr(1), 'g'), chr(1))"


def _sentences_sql(x: str) -> str:
    return f"list_filter(list_transform({_parted(x)}, lambda s: {_stripped('s')}), lambda s: s <> '')"


def _words_cut(x: str, limit: int) -> str:
    w = _squeeze(x)
    soft = f"regexp_replace(regexp_replace(substr({w}, 1, {limit - 3}), ' [^ ]*$', ''), '[,;: ]+$', '')"
    return f"CASE WHEN length({w}) <= {limit} THEN {w} ELSE coalesce(nullif({soft}, ''), substr({w}, 1, {limit - 3})) || '...' END"


def _hard_cut(x: str, limit: int) -> str:
    w = _squeeze(f"coalesce({x}, '')")
    return f"CASE WHEN length({w}) <= {limit} THEN {w} ELSE rtrim(substr({w}, 1, {limit - 1})) || '...' END"


def _mk(x: str) -> str:
    return "lower(" + _squeeze(f"coalesce({x}, '')") + ")"


# Sources ------------------------------------------------------------------------------------------------------------


@query(f"""WITH {_ST}, dc AS (SELECT document_id AS id, min(CAST(time AS DATE)) AS date FROM st WHERE document_id IS NOT NULL GROUP BY 1)
SELECT st.id AS statement_id, document_id, dc.date, who_en AS speaker_name, h1_en AS topic, sequence, procedural, length(content_en) AS n_chars
FROM st JOIN dc ON st.document_id = dc.id WHERE content_en <> '' AND dc.date BETWEEN DATE '2017-01-01' AND DATE '2023-12-31'""")
def s1_debates(spark, d):
    rows = statements(spark, d, "document_id", "time", "content_en", "who_en", "h1_en", "sequence", "procedural")
    found = readers.debates(rows, documents_of(rows), "2017-01-01", "2023-12-31")
    return found.select("statement_id", "document_id", "date", "speaker_name", "topic", "sequence", "procedural", F.length("content").cast("long").alias("n_chars"))


@query(f"""WITH {_ST} SELECT id, CAST(time AS DATE) AS day FROM st WHERE time >= TIMESTAMP '2018-01-01' ORDER BY day DESC, id LIMIT 50""")
def s2_legacy_debates(spark, d):
    flat = statements(spark, d, "time").select("id", F.to_date("time").alias("debate_date"))
    return readers.legacy_debates(flat, "2018-01-01").orderBy(F.desc_nulls_first("debate_date"), "id").limit(50).select("id", F.col("debate_date").alias("day"))


@query("SELECT claim_text, try_strptime(substr(source_date, 1, 10), '%Y-%m-%d')::DATE AS debate_date FROM liar_silver_master")
def s3_verified_claims(spark, d):
    # one table exists, the other does not and gives no rows
    table(spark, d, "liar_silver_master").select("claim_text", V.parse_day("source_date").alias("debate_date")).createOrReplaceTempView("gavel_verified_claims")
    both = [readers.table_or_empty(spark, name).select("claim_text", "debate_date") for name in ("gavel_verified_claims", "fact_claims_that_do_not_exist")]
    return both[0].unionByName(both[1])


@query(f"WITH {_PA} SELECT id, name_en, short_name_en FROM pa")
def s4_parties(spark, d):
    return parties(spark, d).select("id", "name_en", "short_name_en").orderBy("id")


_FACTS = f"""{_BI}, {_PA}, {_VQ}, {_PV},
facts AS (
  SELECT pv.id AS partyvote_id, vq.id AS votequestion_id, bi.id AS bill_id, pa.id AS party_id, pa.name_en AS party_name, vote, vq.date AS vote_date,
    vq.description_en AS votequestion_description, bi.number AS bill_number, coalesce(nullif(bi.short_title_en, ''), nullif(bi.name_en, ''), bi.number) AS bill_title, bi.session_id,
    try_cast(split_part(bi.session_id, '-', 1) AS INT) AS parliamentnum
  FROM pv JOIN vq ON pv.votequestion_id = vq.id JOIN bi ON vq.bill_id = bi.id JOIN pa ON pv.party_id = pa.id
  WHERE vote IN ('Y', 'N') AND vq.date IS NOT NULL
)"""


def _facts(spark, d):
    now = lambda n: records.current(table(spark, d, n))
    return votes.vote_facts(now("bills_partyvote"), now("bills_votequestion"), bills(spark, d), sessions(spark, d), parties(spark, d))


@query(f"WITH {_FACTS} SELECT partyvote_id, votequestion_id, bill_id, party_id, party_name, vote, vote_date, bill_title, parliamentnum FROM facts")
def s5_j1_vote_facts(spark, d):
    found = _facts(spark, d).orderBy("bill_id", "party_id", "vote_date", "votequestion_id")  # T2
    return found.select("partyvote_id", "votequestion_id", "bill_id", "party_id", "party_name", "vote", "vote_date", "bill_title", "parliamentnum")


_CLEAN = _squeeze("regexp_replace(coalesce(content_en, ''), '<[^>]+>', ' ', 'g')")
_SPOKEN = f"""{_ST}, spoken AS (
  SELECT st.id AS statement_id, st.document_id, CAST(st.time AS DATE) AS source_date, who_en, bi.id AS bill_id, bi.number AS bill_number, {_CLEAN} AS source_context
  FROM st JOIN bi ON st.bill_debated_id = bi.id
  WHERE procedural = false AND content_en <> '' AND (content_en ILIKE '%voted for%' OR content_en ILIKE '%voted against%')
)"""


def _spoken(spark, d):
    return votes.bill_statements(statements(spark, d, "document_id", "time", "who_en", "bill_debated_id", "content_en", "procedural"), bills(spark, d), sessions(spark, d))


@query(f"WITH {_BI}, {_SPOKEN} SELECT statement_id, source_date, bill_number, source_context FROM spoken")
def s6_j2_bill_statements(spark, d):
    return _spoken(spark, d).select("statement_id", "source_date", "bill_number", "source_context")


@query(f"""WITH {_ST} SELECT id, CAST(time AS DATE) AS day, sequence FROM st WHERE coalesce(procedural, false) = false AND content_en <> ''
ORDER BY day DESC NULLS FIRST, sequence ASC NULLS LAST, id LIMIT 100""")
def s7_recent_statements(spark, d):
    return silver.recent_statements(statements(spark, d, "time", "sequence", "procedural", "content_en"), None, 100).select("id", F.to_date("time").alias("day"), "sequence")


@query(f"WITH {_ST} SELECT id, bill_debated_id, document_id FROM st WHERE id IN (SELECT try_cast(trim(source_statement_id) AS BIGINT) FROM factcheck_master WHERE regexp_matches(source_statement_id, '^ *[0-9]+ *$'))")
def s8_j9_statement_lookup(spark, d):
    ids = table(spark, d, "factcheck_master").select(V.whole_number(F.when(F.col("source_statement_id").rlike("^ *[0-9]+ *$"), F.trim("source_statement_id"))).alias("key"))
    return readers.lookup(statements(spark, d, "bill_debated_id", "document_id"), ids).select("id", "bill_debated_id", "document_id")


@query(f"WITH {_BI} SELECT id, introduced, latest_debate_date FROM bi WHERE id IN (SELECT try_cast(trim(bill_id) AS BIGINT) FROM factcheck_master WHERE regexp_matches(bill_id, '^ *[0-9]+ *$'))")
def s9_bill_lookup(spark, d):
    ids = table(spark, d, "factcheck_master").select(V.whole_number(F.when(F.col("bill_id").rlike("^ *[0-9]+ *$"), F.trim("bill_id"))).alias("key"))
    return readers.lookup(bills(spark, d), ids).select("id", "introduced", "latest_debate_date")


@query(f"WITH {_ST}, {_BI} SELECT count(*) AS n FROM st JOIN bi ON st.bill_debated_id = bi.id")
def s13_views(spark, d):
    readers.create_views(spark, {"current_statements": statements(spark, d, "bill_debated_id"), "current_bills": bills(spark, d)})
    return spark.sql("SELECT count(*) AS n FROM current_statements s JOIN current_bills b ON s.bill_debated_id = b.id")


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), n AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS size FROM e)
SELECT vec_id, round(v[1] / size, 6) AS first, round(v[-1] / size, 6) AS last, round(list_inner_product(v, v) / size / size, 6) AS own FROM n WHERE size > 0""")
def s16_m6_knowledge_base(spark, d):
    base = readers.knowledge_base(table(spark, d, "embeddings")).where(F.exists("vector", lambda x: x != 0))
    return base.select("vec_id", F.round(F.element_at("vector", 1), 6).alias("first"), F.round(F.element_at("vector", -1), 6).alias("last"), F.round(V.inner_product("vector", "vector"), 6).alias("own"))


# Filters ------------------------------------------------------------------------------------------------------------


@query("SELECT statement_type, count(*) FILTER (WHERE procedural = false) AS f3_known, count(*) FILTER (WHERE coalesce(procedural, false) = false) AS f4_kept FROM hansards_statement GROUP BY 1")
def f3_f4_procedural(spark, d):
    return table(spark, d, "hansards_statement").groupBy("statement_type").agg(F.count_if(~F.col("procedural")).alias("f3_known"), F.count_if(~F.coalesce("procedural", F.lit(False))).alias("f4_kept"))


@query("SELECT id, vote FROM bills_partyvote WHERE vote IN ('Y', 'N')")
def f6_in_list(spark, d):
    return table(spark, d, "bills_partyvote").where(F.col("vote").isin("Y", "N")).select("id", "vote")


@query("SELECT id FROM hansards_statement WHERE who_en <> '' AND content_en <> '' AND (content_en ILIKE '%voted for%' OR content_en ILIKE '%voted against%')")
def f5_f7_vote_text(spark, d):
    rows = table(spark, d, "hansards_statement").where("who_en is not null and who_en <> '' and content_en <> ''")
    return rows.where(F.col("content_en").ilike("%voted for%") | F.col("content_en").ilike("%voted against%")).select("id")


_CLAIMS = "(SELECT 'f' AS t, seq, claim_text FROM factcheck_master UNION ALL SELECT 's', seq, claim_text FROM liar_silver_master) c"


def _claims(spark, d):
    f = table(spark, d, "factcheck_master").select(F.lit("f").alias("t"), "seq", "claim_text")
    return f.unionByName(table(spark, d, "liar_silver_master").select(F.lit("s").alias("t"), "seq", "claim_text"))


_STRIP = "regexp_replace(coalesce(claim_text, ''), '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')"


@query(f"""SELECT t, seq,
  length(coalesce(claim_text, '')) BETWEEN 30 AND 500 AND 2 * length(regexp_replace(coalesce(claim_text, ''), '[^a-zA-Z]', '', 'g')) >= length(coalesce(claim_text, '')) AND NOT {_any("coalesce(claim_text, '')", P.PROCEDURAL)} AS f9_quality,
  length({_STRIP}) BETWEEN 30 AND 420 AND NOT {_any(_STRIP, P.SILVER_LOW_SIGNAL)} AND {_any(_STRIP, P.SILVER_FACTS)} AS f10_usable,
  length(coalesce(claim_text, '')) BETWEEN 45 AND 320 AND NOT {_any("coalesce(claim_text, '')", P.MERGE_LOW_SIGNAL)} AS f12_candidate
FROM {_CLAIMS}""")
def f9_f10_f12_claim_filters(spark, d):
    return _claims(spark, d).select("t", "seq", X.quality_claim("claim_text").alias("f9_quality"), X.usable_claim("claim_text").alias("f10_usable"), X.merge_candidate("claim_text").alias("f12_candidate"))


@query(f"""WITH u AS (SELECT pair_id, unnest(list_filter(regexp_extract_all(coalesce(completion, ''), '[^.!?\\n]+'), lambda s: length(s) > 20)) AS s FROM training_pairs)
SELECT pair_id, count(*) AS n_facts FROM u WHERE {_any("s", P.EXTRACT_FACTS)} GROUP BY 1""")
def f11_r3_fact_parts(spark, d):
    parts = F.filter(F.regexp_extract_all(X.or_empty("completion"), F.lit(r"[^.!?\n]+"), F.lit(0)), lambda s: (F.length(s) > 20) & X.any_match(s, P.EXTRACT_FACTS))
    return table(spark, d, "training_pairs").select("pair_id", F.explode(parts).alias("s")).groupBy("pair_id").agg(F.count("*").alias("n_facts"))


@query(f"""WITH {_ST}, p AS (SELECT id, list_filter({_sentences_sql("regexp_replace(coalesce(content_en, ''), '<[^>]+>', '', 'g')")}, lambda s: length(s) > 20 AND {_any("s", P.EXTRACT_FACTS)}) AS parts FROM st),
u AS (SELECT id, unnest(parts) AS claim_text, generate_subscripts(parts, 1) - 1 AS pos FROM p)
SELECT id, pos, claim_text, {"CASE " + " ".join(f"WHEN {' OR '.join(f'contains(lower(claim_text), {_lit(w)})' for w in words)} THEN '{name}'" for name, words in P.CLAIM_TYPES if name != "vote") + " ELSE 'general' END"} AS claim_type FROM u""")
def f11_fact_sentences(spark, d):
    return statements(spark, d, "content_en").select("id", F.posexplode(X.fact_sentences("content_en")).alias("pos", "claim_text")).withColumn("claim_type", X.claim_type("claim_text", with_vote=False))


@query("""SELECT id, who_en, coalesce(procedural, false) AS skipped FROM hansards_statement WHERE NOT (coalesce(procedural, false) OR coalesce(who_en, '') = '')""")
def f13_skip_rule(spark, d):
    rows = table(spark, d, "hansards_statement")
    return rows.where(~(F.coalesce("procedural", F.lit(False)) | (X.or_empty("who_en") == ""))).select("id", "who_en", F.coalesce("procedural", F.lit(False)).alias("skipped"))


@query("SELECT seq FROM factcheck_master WHERE contains(source_context, claim_text)")
def f18_containment(spark, d):
    return table(spark, d, "factcheck_master").where(F.contains("source_context", "claim_text")).select("seq")


@query("SELECT pair_id FROM training_pairs WHERE regexp_matches(coalesce(completion, ''), '(?m)^VERDICT:\\s*(TRUE|FALSE|MISLEADING|UNVERIFIED)')")
def f20_valid_labels(spark, d):
    return table(spark, d, "training_pairs").where(X.or_empty("completion").rlike(P.VERDICT_PREFIX)).select("pair_id")


# Text ---------------------------------------------------------------------------------------------------------------

_SP = _squeeze("claim_text")
_SOFT = "regexp_replace(regexp_replace(substr({0}, 1, 37), ' [^ ]*$', ''), '[,;: ]+$', '')"


@query(f"""SELECT t, seq, {_SP} AS x1, lower({_squeeze("coalesce(claim_text, '')")}) AS x7, rtrim(regexp_replace(lower({_SP}), '\\.$', '')) AS x8,
  CASE WHEN length({_SP}) <= 40 THEN {_SP} ELSE coalesce(nullif({_SOFT.format(_SP)}, ''), substr({_SP}, 1, 37)) || '...' END AS x9,
  CASE WHEN length({_squeeze("coalesce(claim_text, '')")}) <= 40 THEN {_squeeze("coalesce(claim_text, '')")} ELSE rtrim(substr({_squeeze("coalesce(claim_text, '')")}, 1, 39)) || '...' END AS x10
FROM {_CLAIMS}""")
def x1_x7_x8_x9_x10_keys(spark, d):
    return _claims(spark, d).select("t", "seq", X.spaces("claim_text").alias("x1"), X.match_key("claim_text").alias("x7"), X.claim_key("claim_text").alias("x8"), X.trim_words("claim_text", 40).alias("x9"), X.trim_hard("claim_text", 40).alias("x10"))


@query(f"""SELECT id, loaded_at, md5({_CLEAN}) AS x2, md5({_squeeze("regexp_replace(regexp_replace(content_en, '<[^>]+>', ' ', 'g'), '&[A-Za-z0-9_]+;', ' ', 'g')")}) AS x3,
  md5(regexp_replace(content_en, '<[^>]+>', '', 'g')) AS x4, md5(regexp_replace(content_en, '<[^>]+>', ' ', 'g')) AS x5, md5(replace(content_en, chr(160), ' ')) AS x6 FROM hansards_statement""")
def x2_x3_x4_x5_x6_cleaning(spark, d):
    c = F.col("content_en")
    return table(spark, d, "hansards_statement").select("id", "loaded_at", F.md5(X.clean(c)).alias("x2"), F.md5(X.clean_html(c)).alias("x3"), F.md5(X.untag(c)).alias("x4"), F.md5(F.regexp_replace(c, "<[^>]+>", " ")).alias("x5"), F.md5(X.plain_spaces(c)).alias("x6"))


@query("""SELECT id, loaded_at, regexp_extract(regexp_replace(coalesce(who_en, ''), '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g'), '\\((?:[^()]*,\\s*)?([A-Za-z.]+)\\)$', 1) AS party FROM hansards_statement""")
def x11_speaker_party(spark, d):
    return table(spark, d, "hansards_statement").select("id", "loaded_at", X.speaker_party("who_en").alias("party"))


@query(f"""SELECT t, seq, upper(nullif(regexp_extract(claim_text, {_lit(P.BILL_NUMBER)}, 1), '')) AS bill,
  CASE WHEN len(list_distinct(list_transform(regexp_extract_all(claim_text, {_lit(P.VOTE_PHRASE)}, 1), lambda x: lower(x)))) = 1 THEN lower(regexp_extract(claim_text, {_lit(P.VOTE_PHRASE)}, 1)) END AS direction FROM {_CLAIMS}""")
def x12_x13_bill_and_direction(spark, d):
    return _claims(spark, d).select("t", "seq", X.bill_number("claim_text").alias("bill"), X.vote_direction("claim_text").alias("direction"))


@query("SELECT id, loaded_at, CASE WHEN vote = 'Y' THEN 'for' ELSE 'against' END AS direction FROM bills_partyvote")
def x14_vote_words(spark, d):
    return table(spark, d, "bills_partyvote").select("id", "loaded_at", X.code_direction("vote").alias("direction"))


@query(f"WITH {_PA} SELECT short_name_en, name_en FROM pa WHERE regexp_matches(lower(name_en), 'conservative|liberal|ndp|bloc|green')")
def x15_canadian_aliases(spark, d):
    rows = [r.asDict() for r in parties(spark, d).select("id", "name_en", "short_name_en").orderBy("id").collect()]  # a small fixed table
    found = {name for _, _, name in votes.party_patterns(rows)}
    return parties(spark, d).where(F.col("name_en").isin(*found) if found else F.lit(False)).select("short_name_en", "name_en")


def _type_sql(x: str) -> str:
    arms = " ".join(f"WHEN {' OR '.join(f'contains(lower({x}), {_lit(w)})' for w in words)} THEN '{name}'" for name, words in P.CLAIM_TYPES)
    return f"CASE {arms} ELSE 'general' END"


def _signal_sql(x: str) -> str:
    terms = [f"CASE WHEN regexp_matches({x}, {_lit(p)}) THEN 3 ELSE 0 END" for p in P.MIDDLE_CUES] + [f"CASE WHEN regexp_matches({x}, {_lit(p)}) THEN -5 ELSE 0 END" for p in P.BINARY_CLEAN]
    terms += [f"CASE WHEN regexp_matches({x}, {_lit(P.NUMBER_UNIT)}) THEN 2 ELSE 0 END", f"CASE WHEN regexp_matches({x}, {_lit(P.POPULATION)}) THEN 1 ELSE 0 END"]
    return "(" + " + ".join(terms) + ")"


def _candidate_sql(x: str, kind: str) -> str:
    return f"({_signal_sql(x)} + CASE WHEN {kind} IN ('economic', 'general', 'environmental', 'health') THEN 2 WHEN {kind} = 'vote' THEN -2 WHEN {kind} = 'legislative' THEN 1 ELSE 0 END + CASE WHEN regexp_matches({x}, {_lit(P.RECENCY)}) THEN 1 ELSE 0 END)"


_CT = "coalesce(claim_text, '')"


@query(f"""WITH k AS (SELECT t, seq, claim_text, {_type_sql(_CT)} AS kind FROM {_CLAIMS})
SELECT t, seq, kind, {_signal_sql(_CT)} AS x19, {_candidate_sql(_CT, 'kind')} AS x20 FROM k""")
def x18_x19_x20_types_and_scores(spark, d):
    kinded = _claims(spark, d).withColumn("kind", X.claim_type("claim_text"))
    return kinded.select("t", "seq", "kind", X.signal_score("claim_text").alias("x19"), X.candidate_score("claim_text", "kind").alias("x20"))


@query(f"""WITH {_ST}, p AS (SELECT id, {_sentences_sql("coalesce(content_en, '')")} AS parts FROM st) SELECT id, unnest(parts) AS sentence, generate_subscripts(parts, 1) - 1 AS pos FROM p""")
def x22_sentences(spark, d):
    return statements(spark, d, "content_en").select("id", F.posexplode(X.split_sentences("content_en")).alias("pos", "sentence"))


@query(f"""WITH c AS (SELECT seq, {_squeeze("regexp_replace(coalesce(source_context, ''), '<[^>]+>', ' ', 'g')")} AS c FROM factcheck_master),
p AS (SELECT seq, list_filter(list_transform(regexp_extract_all(c, '[^.?!\\n]+[.?!\\n]?'), lambda s: trim(s)), lambda s: regexp_matches(s, {_lit(P.VOTE_PHRASE)})) AS parts FROM c)
SELECT seq, unnest(list_distinct(parts)) AS sentence FROM p""")
def x23_vote_sentences(spark, d):
    return table(spark, d, "factcheck_master").select("seq", F.explode(X.vote_sentences(X.clean("source_context"))).alias("sentence"))


def _window_sql(at: str, margin: int) -> str:
    return f"substr(whole, greatest({at} - {margin}, 1), least({at} - 1 + length(said) + {margin}, length(whole)) - greatest({at} - {margin}, 1) + 1)"


_AROUND = "array_to_string(parts[greatest(hit - 1, 1):hit + 1], ' ')"
_X25 = f"""l AS (SELECT seq, coalesce(source_context, '') AS whole, coalesce(claim_text, '') AS said, {_sentences_sql("coalesce(source_context, '')")} AS parts FROM factcheck_master),
l2 AS (SELECT *, coalesce(list_position(list_transform(parts, lambda s: contains(s, said)), true), 0) AS hit, instr(whole, said) AS found FROM l),
x25 AS (SELECT seq, CASE WHEN hit > 0 THEN {_words_cut(_AROUND, 1200)} WHEN found > 0 THEN {_words_cut(_window_sql("found", 400), 1200)} ELSE {_words_cut("said", 1200)} END AS x25 FROM l2)"""
_X26 = f"""v AS (SELECT seq, {_squeeze("coalesce(source_context, '')")} AS whole, {_squeeze("coalesce(claim_text, '')")} AS said FROM factcheck_master),
v2 AS (SELECT *, {_parted("whole")} AS parts, instr(whole, said) AS found, instr(lower(whole), lower(said)) AS low FROM v),
v3 AS (SELECT *, coalesce(list_position(list_transform(parts, lambda s: contains(lower(trim(s)), lower(said))), true), 0) AS hit FROM v2),
x26 AS (SELECT seq, CASE WHEN whole = '' THEN said WHEN said = '' THEN {_hard_cut("whole", 1200)} WHEN found > 0 THEN {_hard_cut(_window_sql("found", 420), 1200)} WHEN hit > 0 THEN {_hard_cut(_AROUND, 1200)}
  WHEN low > 0 THEN {_hard_cut(_window_sql("low", 420), 1200)} ELSE {_hard_cut("whole", 1200)} END AS x26 FROM v3)"""


@query(f"WITH {_X25}, {_X26} SELECT seq, x25, x26 FROM x25 JOIN x26 USING (seq)")
def x25_x26_contexts(spark, d):
    return table(spark, d, "factcheck_master").select("seq", X.local_context("source_context", "claim_text").alias("x25"), X.local_context_v2("source_context", "claim_text").alias("x26"))


_QT = _words_cut("coalesce(nullif(" + _squeeze("regexp_replace(coalesce(votequestion_description, ''), '<[^>]+>', ' ', 'g')") + ", ''), 'Vote on Bill ' || bill_number)", 220)


@query(f"""WITH r AS (SELECT *, try_strptime(substr(vote_date, 1, 10), '%Y-%m-%d')::DATE AS day, CASE evidence_vote_direction WHEN 'for' THEN 'for' ELSE 'against' END AS said, CASE evidence_vote_direction WHEN 'for' THEN 'against' ELSE 'for' END AS other FROM factcheck_master),
t AS (SELECT *, coalesce(strftime(day, '%Y-%m-%d'), 'null') AS d, coalesce(party_name, 'null') AS p, coalesce({_QT}, 'null') AS q FROM r)
SELECT seq, 'House vote question: "' || q || '" The ' || p || ' voted ' || said || ' on ' || d || '.' AS evidence,
  CASE WHEN label = 'True' THEN 'True. DB vote record shows the ' || p || ' voted ' || said || ' on that House vote question on ' || d || '.' ELSE 'False. DB vote record shows the ' || p || ' voted ' || said || ', not ' || other || ', on that House vote question on ' || d || '.' END AS explanation FROM t""")
def x28_templates(spark, d):
    rows = table(spark, d, "factcheck_master").withColumn("vote", F.when(F.col("evidence_vote_direction") == "for", "Y").otherwise("N")).withColumn("day", V.parse_day("vote_date"))
    return rows.select("seq", votes.evidence_sentence("party_name", "vote", "day", "votequestion_description", "bill_number").alias("evidence"), votes.explanation_sentence("label", "party_name", "vote", "day").alias("explanation"))


def _or(x: str, y: str) -> str:
    return f"coalesce(nullif({x}, ''), {y})"


@query(f"""SELECT seq, md5({_lit(templates.ANALYZE)} || chr(10) || chr(10) || 'Claim: "' || coalesce(claim_text, '') || '"' || chr(10) || 'Speaker: ' || {_or('source_speaker', "'Unknown'")} || chr(10) || 'Date: ' || {_or('source_date', "'Unknown'")} || chr(10)
  || 'Bill: ' || coalesce(bill_number, '') || chr(10) || 'Named party: ' || coalesce(party_name, '') || chr(10) || 'Vote date: ' || coalesce(vote_date, '') || chr(10) || chr(10) || 'Context: ' || coalesce(source_context_local, '') || chr(10) || chr(10)
  || 'Evidence: ' || coalesce(evidence_text, '') || chr(10) || chr(10) || {_lit(templates.VOTE_FORMAT)}) AS prompt_md5 FROM factcheck_master""")
def x29_p11_vote_pairs(spark, d):
    return table(spark, d, "factcheck_master").select("seq", F.md5(templates.vote_prompt()).alias("prompt_md5"))


def _na(c: str, other: str = "'N/A'") -> str:
    return f"coalesce(nullif({c}, ''), {other})"


_QV = _words_cut("coalesce(nullif(votequestion_description, ''), 'Vote on Bill ' || coalesce(bill_number, ''))", 220)


@query(f"""SELECT seq, md5({_lit(templates.ANALYZE)} || chr(10) || chr(10) || 'Claim: "' || coalesce(claim_text, '') || '"' || chr(10) || 'Speaker: ' || {_na("source_speaker", "'Unknown'")} || chr(10) || 'Date: ' || {_na("source_date", "'Unknown'")}
  || chr(10) || 'Context: ' || coalesce(nullif(source_context_local, ''), nullif(source_context, ''), 'N/A') || chr(10) || 'Evidence: ' || {_na("evidence_text")} || chr(10) || 'Provenance:' || chr(10) || 'Claim type: ' || coalesce(claim_type, 'unknown')
  || chr(10) || 'Bill: ' || {_na("bill_number")} || chr(10) || 'Bill session: ' || {_na("session_id")} || chr(10) || 'Source statement id: ' || {_na("source_statement_id")} || chr(10) || 'Evidence ids: ' || {_na("evidence_primary_ids")} || chr(10) || chr(10) || {_lit(templates.GOLD_FORMAT)}) AS prompt_md5,
  'VERDICT: ' || upper(coalesce(label, '')) || chr(10) || 'CONFIDENCE: 100' || chr(10) || 'EXPLANATION: ' || {_hard_cut("explanation", 300)} || chr(10) || 'CORRECTION: ' || CASE WHEN label = 'True' THEN 'N/A' ELSE {_hard_cut("coalesce(nullif(evidence_text, ''), explanation)", 240)} END AS completion,
  'VERDICT: ' || upper(coalesce(label, '')) || chr(10) || 'CONFIDENCE: 100' || chr(10) || 'EXPLANATION: ' || coalesce(explanation, '') || chr(10) || 'CORRECTION: ' || CASE WHEN label = 'True' THEN 'N/A'
    ELSE 'The ' || coalesce(party_name, '') || ' voted ' || coalesce(evidence_vote_direction, '') || ' on the House vote question "' || {_QV} || '" on ' || coalesce(vote_date, '') || '.' END AS vote_completion FROM factcheck_master""")
def x29_p11_gold_pairs(spark, d):
    rows = table(spark, d, "factcheck_master")
    return rows.select("seq", F.md5(templates.gold_prompt()).alias("prompt_md5"), templates.gold_completion().alias("completion"), templates.vote_completion().alias("vote_completion"))


@query(f"""SELECT seq, md5({_lit(templates.ANALYZE_SILVER)} || chr(10) || chr(10) || 'Claim: "' || coalesce(claim_text, '') || '"' || chr(10) || 'Speaker: ' || {_na("source_speaker", "'Unknown'")} || chr(10) || 'Date: ' || {_na("source_date", "'Unknown'")} || chr(10) || 'Claim type: ' || {_na("claim_type", "'general'")}
  || chr(10) || 'Local context: ' || coalesce(nullif(source_context_local, ''), nullif(source_context, ''), 'N/A') || chr(10) || 'Evidence: ' || {_na("evidence_text")} || chr(10) || chr(10) || {_lit(templates.SILVER_FORMAT)}) AS prompt_md5 FROM liar_silver_master""")
def x29_silver_prompts(spark, d):
    return table(spark, d, "liar_silver_master").select("seq", F.md5(templates.silver_prompt()).alias("prompt_md5"))


_DE = _squeeze("coalesce(label_rationale, '')")


@query(f"""SELECT seq, 'VERDICT: ' || upper(coalesce(label, '')) || chr(10) || 'CONFIDENCE: ' || {_or('label_confidence', "'N/A'")} || chr(10) || 'EXPLANATION: '
  || CASE WHEN length({_DE}) <= 260 THEN {_DE} ELSE rtrim(substr({_DE}, 1, 259)) || '...' END || chr(10) || 'CORRECTION: '
  || CASE WHEN label IN ('false', 'pants-fire', 'barely-true', 'half-true') THEN CASE WHEN length({_squeeze("coalesce(evidence_text, '')")}) <= 220 THEN {_squeeze("coalesce(evidence_text, '')")} ELSE rtrim(substr({_squeeze("coalesce(evidence_text, '')")}, 1, 219)) || '...' END ELSE 'N/A' END AS completion
FROM liar_silver_master""")
def x29_p11_silver_pairs(spark, d):
    return table(spark, d, "liar_silver_master").select("seq", templates.silver_completion().alias("completion"))


@query(f"""SELECT pair_id, nullif(regexp_extract(coalesce(completion, ''), '(?im)^\\s*VERDICT:\\s*(TRUE|FALSE|MISLEADING|UNVERIFIED)\\s*$', 1), '') AS strict,
  nullif(regexp_extract(coalesce(completion, ''), {_lit(P.VERDICT_PREFIX)}, 1), '') AS loose, upper(nullif(regexp_extract(coalesce(completion, ''), {_lit(P.VERDICT_API)}, 1), '')) AS api,
  lower(regexp_extract(coalesce(completion, ''), {_lit(P.VERDICT_TOKEN)}, 1)) AS token FROM training_pairs""")
def x32_verdicts(spark, d):
    c = X.or_empty("completion")
    return table(spark, d, "training_pairs").select("pair_id", X.extract(c, P.VERDICT_STRICT).alias("strict"), X.extract(c, P.VERDICT_PREFIX).alias("loose"), F.upper(X.extract(c, P.VERDICT_API)).alias("api"), F.lower(F.regexp_extract(c, P.VERDICT_TOKEN, 1)).alias("token"))


@query(f"""SELECT pair_id, {" AND ".join(f"regexp_matches(coalesce(completion, ''), {_lit(p)})" for p in (P.VERDICT_STRICT, P.CONFIDENCE_LINE, P.EXPLANATION_LINE, P.CORRECTION_LINE))} AS complete FROM training_pairs""")
def x33_required_format(spark, d):
    return table(spark, d, "training_pairs").select("pair_id", X.has_format("completion").alias("complete"))


@query(f"""SELECT pair_id, regexp_replace(regexp_extract(coalesce(prompt, ''), {_lit(P.PROMPT_CLAIM)}, 1), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') AS claim FROM training_pairs""")
def x34_prompt_claims(spark, d):
    return table(spark, d, "training_pairs").select("pair_id", merge.prompt_claim("prompt").alias("claim"))


@query("""SELECT seq, CASE WHEN regexp_matches(claim_text, '(?i)\\bvoted for\\b') THEN regexp_replace(claim_text, '(?is)^(.*?)\\bvoted for\\b', '\\1voted against') ELSE regexp_replace(claim_text, '(?is)^(.*?)\\bvoted against\\b', '\\1voted for') END AS flipped FROM factcheck_master""")
def x35_flips(spark, d):
    return table(spark, d, "factcheck_master").select("seq", X.flip_direction("claim_text").alias("flipped"))


@query("SELECT pair_id, length(prompt) AS n, upper(source_dataset) AS up, substr(completion, 1, 20) AS head, CASE WHEN ends_with(completion, '</s>') THEN completion ELSE completion || '</s>' END AS ended FROM training_pairs")
def x38_x39_scalars(spark, d):
    return table(spark, d, "training_pairs").select("pair_id", F.length("prompt").cast("long").alias("n"), F.upper("source_dataset").alias("up"), F.substring("completion", 1, 20).alias("head"), X.with_end("completion", "</s>").alias("ended"))


_QD = _squeeze("regexp_replace(coalesce(description_en, ''), '<[^>]+>', ' ', 'g')")
_Q27 = f"coalesce(nullif({_QD}, ''), 'Vote on Bill ' || CAST(bill_id AS VARCHAR))"


@query(f"SELECT id, loaded_at, {_Q27} AS x27 FROM bills_votequestion")
def x27_question_texts(spark, d):
    return table(spark, d, "bills_votequestion").select("id", "loaded_at", votes.question_text("description_en", F.col("bill_id").cast("string")).alias("x27"))


@query(f"""SELECT seq, md5({_lit(templates.ANALYZE)} || chr(10) || chr(10) || 'Claim: "' || coalesce(claim_text, '') || '"' || chr(10) || CASE WHEN coalesce(source_speaker, '') <> '' THEN 'Speaker: ' || source_speaker ELSE '' END || chr(10)
  || CASE WHEN coalesce(source_date, '') <> '' THEN 'Date: ' || source_date ELSE '' END || chr(10) || CASE WHEN coalesce(source_context, '') <> '' THEN 'Context: ' || substr(source_context, 1, 300) || '...' ELSE '' END || chr(10) || chr(10) || {_lit(templates.API_FORMAT)}) AS prompt_md5 FROM liar_silver_master""")
def x30_api_prompts(spark, d):
    return table(spark, d, "liar_silver_master").select("seq", F.md5(templates.api_prompt("claim_text", "source_speaker", "source_date", "source_context")).alias("prompt_md5"))


@query(f"""SELECT seq, md5({_lit(templates.LABELLING % ", ".join(P.SILVER_LABELS))} || chr(10) || chr(10) || 'Claim:' || chr(10) || coalesce(claim_text, '') || chr(10) || chr(10) || 'Local context:' || chr(10) || coalesce(source_context_local, '') || chr(10) || chr(10)
  || 'Full context:' || chr(10) || coalesce(source_context, '') || chr(10) || chr(10) || 'Source:' || chr(10) || 'Speaker: ' || {_na("source_speaker", "'Unknown'")} || chr(10) || 'Date: ' || {_na("source_date", "'Unknown'")} || chr(10) || 'Topic: ' || coalesce(nullif(source_topic_h2, ''), nullif(source_topic_h1, ''), 'Unknown')) AS prompt_md5 FROM liar_silver_master""")
def x31_labelling_prompts(spark, d):
    rows = table(spark, d, "liar_silver_master").select("seq", "claim_text", F.col("source_speaker").alias("speaker"), F.col("source_date").alias("date"), F.col("source_topic_h1").alias("h1_en"), F.col("source_topic_h2").alias("h2_en"), "source_context_local", F.col("source_context").alias("full_context"))
    return rows.select("seq", F.md5(templates.labelling_prompt()).alias("prompt_md5"))


@query("SELECT seq, CASE WHEN contains(explanation, 'The') THEN substr(explanation, 1, instr(explanation, 'The') - 1) || 'This' || substr(explanation, instr(explanation, 'The') + 3) ELSE explanation END AS x36, regexp_replace(regexp_replace(trim(evidence_json), '^```(?:json)?\\s*', ''), '\\s*```$', '') AS x37 FROM factcheck_master")
def x36_x37_replacements(spark, d):
    return table(spark, d, "factcheck_master").select("seq", X.replace_first("explanation", "The", "This").alias("x36"), X.unfence("evidence_json").alias("x37"))


@query(f"""SELECT pair_id, coalesce(upper(nullif(regexp_extract(completion, {_lit(P.VERDICT_API)}, 1), '')), 'UNVERIFIED') AS verdict, coalesce(try_cast(nullif(regexp_extract(completion, {_lit(P.API_CONFIDENCE)}, 1), '') AS DOUBLE), 50) / 100 AS confidence,
  coalesce({_stripped(f"nullif(regexp_extract(completion, {_lit(P.API_EXPLANATION)}, 1), '')")}, 'No explanation generated') AS explanation, {_stripped(f"nullif(regexp_extract(completion, {_lit(P.API_CORRECTION)}, 1), '')")} AS correction FROM training_pairs""")
def x32_api_fields(spark, d):
    fields = templates.api_fields("completion")
    return table(spark, d, "training_pairs").select("pair_id", *[c.alias(name) for name, c in fields.items()])


@query(f"""SELECT seq, {_lit(templates.ANALYZE_PLAIN)} || chr(10) || chr(10) || 'Claim: "' || claim_text || '"' || chr(10) || 'Speaker: ' || source_speaker || ' (Unknown)' || chr(10) || 'Date: ' || source_date || chr(10) || 'Topic: ' || coalesce(source_topic_h2, 'General Debate')
  || chr(10) || chr(10) || 'Context: ' || substr(source_context, 1, 500) || '...' || chr(10) || chr(10) || {_lit(templates.ASK_PLAIN)} AS prompt,
  'Verification: ' || label || chr(10) || chr(10) || 'Evidence: ' || coalesce(evidence_text, 'No source provided') || chr(10) || chr(10) || 'Explanation: ' || label_rationale || chr(10) || chr(10) || 'Confidence: ' || coalesce(label_confidence, 'Medium') AS completion FROM liar_silver_master""")
def x29_plain_pairs(spark, d):
    rows = table(spark, d, "liar_silver_master").select("seq", "claim_text", F.col("source_speaker").alias("speaker_name"), F.lit(None).cast("string").alias("party"), F.col("source_date").alias("debate_date"), F.col("source_topic_h2").alias("topic"), F.col("source_context").alias("full_context"), F.col("label").alias("verification_status"), F.col("evidence_text").alias("evidence_source"), F.col("label_rationale").alias("explanation"), F.col("label_confidence").alias("confidence_score"))
    prompt, answer = templates.plain_pair()
    return rows.select("seq", prompt.alias("prompt"), answer.alias("completion"))


@query("SELECT seq, claim_text AS claim, false AS verified, 0 AS n_sources FROM factcheck_master")
def v6_v7_external_stubs(spark, d):
    check = boundaries.verification_stub("claim_text")
    return table(spark, d, "factcheck_master").select("seq", check["claim"].alias("claim"), check["verified"].alias("verified"), F.size(check["sources"]).cast("long").alias("n_sources"))


# Values -------------------------------------------------------------------------------------------------------------


@query("""SELECT seq, try_strptime(substr(source_date, 1, 10), '%Y-%m-%d')::DATE AS day, date_diff('day', try_strptime(substr(vote_date, 1, 10), '%Y-%m-%d')::DATE, try_strptime(substr(source_date, 1, 10), '%Y-%m-%d')::DATE) AS days,
  CASE WHEN regexp_matches(coalesce(source_date, ''), '^[0-9]{4}') THEN CAST(substr(source_date, 1, 4) AS INT) ELSE 0 END AS year FROM factcheck_master""")
def d1_d2_d4_dates(spark, d):
    day = V.parse_day("source_date")
    return table(spark, d, "factcheck_master").select("seq", day.alias("day"), F.datediff(day, V.parse_day("vote_date")).cast("long").alias("days"), V.year_of("source_date").alias("year"))


@query("SELECT id, loaded_at, strftime(introduced, '%Y-%m-%d') AS iso FROM bills_bill")
def d3_iso_dates(spark, d):
    return table(spark, d, "bills_bill").select("id", "loaded_at", F.date_format("introduced", "yyyy-MM-dd").alias("iso"))


@query("""WITH n AS (SELECT seq, try_cast(trim(label_confidence) AS DOUBLE) AS v FROM liar_silver_master), s AS (SELECT seq, CASE WHEN v BETWEEN 0 AND 1 THEN v * 100 ELSE v END AS v FROM n)
SELECT seq, CASE WHEN v IS NOT NULL THEN CAST(greatest(0, least(100, round_even(v, 0))) AS INT) END AS percent FROM s""")
def m2_confidence(spark, d):
    return table(spark, d, "liar_silver_master").select("seq", V.percent(F.trim("label_confidence")).alias("percent"))


@query("SELECT seq, CASE WHEN regexp_matches(source_statement_id, '^[ ]*[+-]?[0-9]+[ ]*$') THEN try_cast(trim(source_statement_id) AS BIGINT) END AS n FROM factcheck_master")
def m4_whole_numbers(spark, d):
    return table(spark, d, "factcheck_master").select("seq", V.whole_number("source_statement_id").alias("n"))


@query("SELECT seq, 'silver_' || substr(sha1(coalesce(claim_text, '') || '|' || coalesce(source_statement_id, '') || '|' || coalesce(source_date, '')), 1, 12) AS id FROM liar_silver_master")
def h1_claim_ids(spark, d):
    return table(spark, d, "liar_silver_master").select("seq", V.claim_id("claim_text", "source_statement_id", "source_date").alias("id"))


@query(f"""WITH u AS (SELECT seq, json_extract_string(evidence_provenance_json, '$[0].url') AS url FROM liar_silver_master),
h AS (SELECT seq, lower(regexp_replace(regexp_extract(coalesce(url, ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1), '^.*@', '')) AS host FROM u)
SELECT seq, host, {" OR ".join(f"ends_with(host, '{s}')" for s in P.OFFICIAL_SUFFIXES)} AS official FROM h""")
def h2_f17_official(spark, d):
    url = F.coalesce(F.get_json_object("evidence_provenance_json", "$[0].url"), F.lit(""))
    return table(spark, d, "liar_silver_master").select("seq", V.authority(url).alias("host"), V.official(url).alias("official"))


@query("SELECT seq, json_extract_string(evidence_json, '$.party') AS party, try_cast(json_extract_string(evidence_json, '$.division') AS BIGINT) AS division FROM factcheck_master")
def q1_q2_json(spark, d):
    parsed = V.tolerant_json("evidence_json", "party string, division bigint")
    return table(spark, d, "factcheck_master").withColumn("p", parsed).select("seq", "p.party", "p.division")


@query("SELECT seq, CAST(json_object('bill_number', bill_number, 'party_name', party_name, 'vote_date', vote_date, 'yea_total', try_cast(yea_total AS INT)) AS VARCHAR) AS json FROM factcheck_master")
def q1_sorted_json(spark, d):
    struct = F.struct("bill_number", "party_name", "vote_date", F.col("yea_total").try_cast("int").alias("yea_total"))
    return table(spark, d, "factcheck_master").select("seq", V.sorted_json(struct).alias("json"))


@query("SELECT pair_id, CASE pair_id % 3 WHEN 0 THEN completion WHEN 1 THEN completion || chr(10) || 'end' ELSE 'own text' END AS text FROM training_pairs WHERE completion <> ''")
def q3_envelopes(spark, d):
    # the parts of an answer: one; three with an empty one, in two outputs; an answer with its own text as well
    part = lambda *texts: F.struct(F.array(*[F.struct(t.alias("text")) for t in texts]).alias("content"))
    many = F.array(part(F.col("completion"), F.lit("")), part(F.lit("end")))
    kind = F.col("pair_id") % 3
    envelope = F.to_json(F.struct(F.when(kind == 2, "own text").otherwise("").alias("output_text"), F.when(kind == 1, many).otherwise(F.array(part(F.col("completion")))).alias("output")))
    return table(spark, d, "training_pairs").where("completion <> ''").withColumn("envelope", envelope).select("pair_id", V.output_text("envelope").alias("text"))


@query(f"""WITH u AS (SELECT seq, source_statement_id, list_concat(coalesce(json_extract_string(evidence_provenance_json, '$[*].url'), []), [CASE seq % 4 WHEN 0 THEN 'https://www.parl.ca/x' WHEN 1 THEN 'https://parl.ca.example.org/x' WHEN 2 THEN '  ' ELSE 'http://user@lop.parl.gc.ca/y' END]) AS urls FROM liar_silver_master),
k AS (SELECT seq, source_statement_id, list_filter(list_transform(urls, lambda u: {_stripped("coalesce(u, '')")}), lambda u: u = '' OR {" OR ".join(f"ends_with(lower(regexp_replace(regexp_extract(u, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1), '^.*@', '')), '{x}')" for x in P.OFFICIAL_SUFFIXES)}) AS kept FROM u)
SELECT seq, 1 + len(kept) AS n_items, array_to_string(list_concat([''], kept), '|') AS urls, 'Statement ' || coalesce(source_statement_id, '') || ' provides the natural claim context.' AS why FROM k""")
def q4_provenance(spark, d):
    url = F.when(F.col("seq") % 4 == 0, "https://www.parl.ca/x").when(F.col("seq") % 4 == 1, "https://parl.ca.example.org/x").when(F.col("seq") % 4 == 2, "  ").otherwise("http://user@lop.parl.gc.ca/y")
    more = F.array(F.struct(F.lit("t").alias("title"), url.alias("url"), F.lit(None).cast("string").alias("source_type"), F.lit(None).cast("string").alias("why_relevant")))
    sources = F.concat(F.coalesce(F.from_json("evidence_provenance_json", f"array<{V.SOURCE}>"), F.array().cast(f"array<{V.SOURCE}>")), more)
    items = V.provenance("source_statement_id", sources)
    return table(spark, d, "liar_silver_master").select("seq", F.size(items).cast("long").alias("n_items"), F.array_join(F.transform(items, lambda s: s["url"]), "|").alias("urls"), items[0]["why_relevant"].alias("why"))


@query("SELECT pair_id, metadata.claim_id AS claim_id, lower(metadata.label) AS merged_label, source_dataset FROM training_pairs")
def q5_q6_metadata(spark, d):
    merged = merge.merged_metadata(F.col("metadata"), "source_dataset", F.col("metadata.label"), F.coalesce("metadata.claim_text", merge.prompt_claim("prompt")))
    return table(spark, d, "training_pairs").withColumn("m", merged).select("pair_id", "m.claim_id", "m.merged_label", "m.source_dataset")


@query("SELECT id, loaded_at, coalesce(nullif(short_title_en, ''), nullif(name_en, ''), number) AS title FROM bills_bill")
def c1_c2_defaults(spark, d):
    return table(spark, d, "bills_bill").select("id", "loaded_at", X.or_else("short_title_en", F.col("name_en"), F.col("number")).alias("title"))


# Joins --------------------------------------------------------------------------------------------------------------


def _patterns(spark, d):
    rows = [r.asDict() for r in parties(spark, d).select("id", "name_en", "short_name_en").orderBy("id").collect()]  # a small fixed table
    return votes.party_patterns(rows, votes.own_aliases(rows))


_PAIRS = """pr AS (SELECT pair_id, prompt, completion, metadata.claim_id AS claim_id FROM training_pairs),
ms AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY seq DESC) AS rn_ FROM factcheck_master WHERE claim_id IS NOT NULL) WHERE rn_ = 1)"""


def _items(spark, d):
    """Pairs and masters share claim numbers here, not ids: ``vote-7`` is matched to ``claim-7``."""
    pairs = table(spark, d, "training_pairs").select("pair_id", "prompt", "completion", F.regexp_replace("metadata.claim_id", "^[a-z]+-", "claim-").alias("claim_id"))
    return merge.training_items(pairs, table(spark, d, "factcheck_master"), "gold")


@query("""WITH ms AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY seq DESC) AS rn_ FROM factcheck_master WHERE claim_id IS NOT NULL) WHERE rn_ = 1)
SELECT pair_id, ms.claim_id, ms.claim_text, lower(regexp_extract(coalesce(completion, ''), '(?m)^VERDICT:\\s*([A-Z-]+)', 1)) AS label
FROM training_pairs t JOIN ms ON regexp_replace(t.metadata.claim_id, '^[a-z]+-', 'claim-') = ms.claim_id""")
def j5_training_items(spark, d):
    return _items(spark, d).select("pair_id", "claim_id", "claim_text", "label")


@query(f"""SELECT seq FROM liar_silver_master s WHERE NOT EXISTS (SELECT 1 FROM (SELECT metadata.claim_text AS c FROM training_pairs) p WHERE {_mk('p.c')} = {_mk('s.claim_text')})""")
def j7_u3_untaken_claims(spark, d):
    taken = table(spark, d, "training_pairs").select(F.col("metadata.claim_text").alias("claim_text"))
    return records.without_claims(table(spark, d, "liar_silver_master"), taken).select("seq")


@query("SELECT DISTINCT id FROM hansards_statement WHERE id IS NOT NULL AND id NOT IN (SELECT try_cast(trim(source_statement_id) AS BIGINT) FROM liar_silver_master WHERE try_cast(trim(source_statement_id) AS BIGINT) IS NOT NULL)")
def j8_unsaved_statements(spark, d):
    saved = table(spark, d, "liar_silver_master").select(V.whole_number("source_statement_id").alias("key"))
    return records.without_keys(table(spark, d, "hansards_statement").where("id is not null"), saved, F.col("id")).select("id").distinct()


@query(f"""WITH {_ST}, {_BI}, f AS (SELECT seq, CASE WHEN regexp_matches(source_statement_id, '^[ ]*[0-9]+[ ]*$') THEN try_cast(trim(source_statement_id) AS BIGINT) END AS sid, CASE WHEN regexp_matches(bill_id, '^[ ]*[0-9]+[ ]*$') THEN try_cast(trim(bill_id) AS BIGINT) END AS bid FROM factcheck_master)
SELECT seq, st.bill_debated_id AS meta_bill_id, bi.introduced AS meta_introduced FROM f LEFT JOIN st ON f.sid = st.id LEFT JOIN bi ON f.bid = bi.id""")
def j6_metadata(spark, d):
    rows = table(spark, d, "factcheck_master")
    meta = statements(spark, d, "bill_debated_id").withColumn("session_id", F.lit(None).cast("string"))
    return gold.with_metadata(rows, meta, bills(spark, d)).select("seq", "meta_bill_id", "meta_introduced")


@query("""WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 100 = 0), b AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT query_id, id, list_cosine_similarity(q.v, b.v) AS score FROM q, b), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, id) AS rn FROM s)
SELECT query_id, id, round(score, 6) AS score, rn FROM r WHERE rn <= 5""")
def j11_w5_top_k(spark, d):
    rows = table(spark, d, "embeddings")
    base = rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    found = retrieval.top_k(base, rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), 5)
    return found.select("query_id", "id", F.round("score", 6).alias("score"), "rn")


@query("""WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 100 = 0), b AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT query_id, id, list_cosine_similarity(q.v, b.v) AS score FROM q, b), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, id) AS rn FROM s)
SELECT query_id, id FROM r WHERE rn <= 5 AND score > 0.7""")
def f19_threshold_after_top_k(spark, d):
    rows = table(spark, d, "embeddings")
    base = rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return retrieval.top_k(base, rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), 5, least=0.7).select("query_id", "id")


@query("""SELECT seq, count(*) FILTER (WHERE vote_date = source_date AND source_date IS NOT NULL) OVER (PARTITION BY bill_number, party_name) AS n_exact FROM factcheck_master""")
def j12_exact_day(spark, d):
    return votes.exact_day_matches(table(spark, d, "factcheck_master"), ["bill_number", "party_name"], "source_date", "vote_date").select("seq", "n_exact")


# The vote matcher ---------------------------------------------------------------------------------------------------

_MATCH = f"""WITH {_FACTS}, {_SPOKEN}, alias AS (SELECT id AS party_id, '\\b(?:' || replace(trim(name_en), '.', '\\.') || ')\\b' AS p FROM pa WHERE short_name_en <> '' AND name_en <> ''),
raw AS (SELECT *, list_filter(list_transform(regexp_extract_all(source_context, '[^.?!\\n]+[.?!\\n]?'), lambda s: trim(s)), lambda s: regexp_matches(s, {_lit(P.VOTE_PHRASE)})) AS every FROM spoken),
parts AS (SELECT *, list_filter(every, lambda s, i: list_position(every, s) = i) AS ss FROM raw),
sent AS (SELECT statement_id, bill_id, bill_number, source_date, unnest(ss) AS claim_text, generate_subscripts(ss, 1) - 1 AS pos FROM parts),
seen AS (
  SELECT statement_id, pos, count(DISTINCT party_id) AS n_all,
    count(DISTINCT party_id) FILTER (WHERE near) AS n_near, min(party_id) FILTER (WHERE near) AS party_id
  FROM (
    SELECT statement_id, pos, party_id, regexp_matches(pre, '(?i)' || p) AND length(gap) <= 80 AND NOT regexp_matches(gap, '[.!?\\n]') AND NOT regexp_matches(gap, {_lit(P.GAP_WORDS)}) AS near
    FROM (SELECT statement_id, pos, party_id, p, pre, regexp_extract(pre, '(?is)^.*' || p || '(.*)$', 1) AS gap
      FROM (SELECT statement_id, pos, claim_text, regexp_extract(claim_text, '(?is)^(.*?)\\bvoted\\s+(?:for|against)\\b', 1) AS pre FROM sent) s, alias WHERE regexp_matches(claim_text, '(?i)' || p))
  ) GROUP BY ALL
), dirs AS (
  SELECT sent.*, n_all, n_near, party_id, nullif(upper(regexp_extract(claim_text, {_lit(P.BILL_NUMBER)}, 1)), '') AS named,
    list_distinct(list_transform(regexp_extract_all(claim_text, {_lit(P.VOTE_PHRASE)}, 1), lambda x: lower(x))) AS d
  FROM sent LEFT JOIN seen USING (statement_id, pos)
), first_reason AS (
  SELECT *, CASE WHEN named IS NOT NULL AND named <> upper(coalesce(bill_number, '')) THEN 'bill_number_mismatch' WHEN len(d) <> 1 THEN 'direction_ambiguous'
    WHEN regexp_matches(claim_text, {_lit(P.ELECTORATE)}) THEN 'electorate_language' WHEN regexp_matches(claim_text, {_lit(P.UNCERTAIN)}) THEN 'uncertain_claim_language'
    WHEN coalesce(n_all, 0) <> 1 OR coalesce(n_near, 0) <> 1 THEN 'party_ambiguous_or_missing' END AS r1 FROM dirs
), hits AS (
  SELECT f.statement_id, f.pos, count(facts.partyvote_id) AS n, count(*) FILTER (WHERE facts.vote_date = f.source_date) AS n_exact,
    min(facts.partyvote_id) AS only_fact, min(facts.partyvote_id) FILTER (WHERE facts.vote_date = f.source_date) AS day_fact
  FROM first_reason f LEFT JOIN facts ON f.r1 IS NULL AND f.bill_id = facts.bill_id AND f.party_id = facts.party_id GROUP BY ALL
), second AS (
  SELECT f.*, CASE WHEN r1 IS NOT NULL THEN r1 WHEN n = 0 THEN 'no_vote_fact' WHEN n = 1 OR n_exact = 1 THEN NULL WHEN n_exact > 1 THEN 'ambiguous_vote_fact' ELSE 'multiple_vote_events' END AS r2,
    CASE WHEN n = 1 THEN only_fact WHEN n_exact = 1 THEN day_fact END AS fact
  FROM first_reason f JOIN hits USING (statement_id, pos)
), third AS (
  SELECT s.*, facts.vote, facts.partyvote_id, {" ".join(["CASE"] + [f"WHEN r2 IS NULL AND regexp_matches(claim_text, '(?i)\\b{w}\\b') AND NOT regexp_matches(lower(coalesce(votequestion_description, '')), '\\b{w}\\b') THEN 'vote_object_mismatch_{w}'" for w in P.VOTE_OBJECTS] + ["END"])} AS r3
  FROM second s LEFT JOIN facts ON s.r2 IS NULL AND s.fact = facts.partyvote_id
), final AS (
  SELECT statement_id, pos, claim_text, coalesce(r2, r3) AS reason, CASE WHEN coalesce(r2, r3) IS NULL THEN CASE WHEN (CASE WHEN vote = 'Y' THEN 'for' ELSE 'against' END) = d[1] THEN 'True' ELSE 'False' END END AS label, partyvote_id FROM third
)
"""


def _matched(spark, d):
    spoken, facts = cut(_spoken(spark, d)), cut(_facts(spark, d))  # facts have three uses
    return votes.vote_claims(spoken, facts, _patterns(spark, d)), spoken, facts


@query(_MATCH + "SELECT statement_id, claim_text, reason, label, partyvote_id FROM final")
def j4_f14_f15_f21_x16_vote_claims(spark, d):
    return _matched(spark, d)[0].select("statement_id", "claim_text", "reason", "label", "partyvote_id")


@query(_MATCH + """SELECT 'candidate.sentences' AS name, count(*) AS value FROM final UNION ALL SELECT 'skipped.' || reason, count(*) FROM final WHERE reason IS NOT NULL GROUP BY 1
UNION ALL SELECT 'unresolved.statements', count(*) FROM spoken WHERE source_context <> '' AND statement_id NOT IN (SELECT statement_id FROM final WHERE label IS NOT NULL)""")
def a20_drop_counts(spark, d):
    claims, spoken, _ = _matched(spark, d)
    return votes.drop_counts(cut(claims), spoken)


_NUMBERED = """, rows_ AS (
  SELECT row_number() OVER (ORDER BY spoken.source_date, final.statement_id, pos) AS seq, final.claim_text, label, spoken.*, facts.vote, facts.partyvote_id, facts.party_id, facts.party_name, facts.votequestion_id, strftime(facts.vote_date, '%Y-%m-%d') AS day,
    facts.votequestion_description, facts.bill_title, facts.session_id, facts.parliamentnum, vq.result, vq.yea_total, vq.nay_total, CASE vote WHEN 'Y' THEN 'for' ELSE 'against' END AS said, CASE vote WHEN 'Y' THEN 'against' ELSE 'for' END AS other
  FROM final JOIN spoken USING (statement_id) JOIN facts ON final.partyvote_id = facts.partyvote_id JOIN vq ON facts.votequestion_id = vq.id WHERE label IS NOT NULL
)"""
_QF = _words_cut("coalesce(nullif(" + _squeeze("regexp_replace(coalesce(votequestion_description, ''), '<[^>]+>', ' ', 'g')") + ", ''), 'Vote on Bill ' || bill_number)", 220)


@query(_MATCH + _NUMBERED + f""", l AS (SELECT *, source_context AS whole, claim_text AS said_, {_sentences_sql("source_context")} AS parts FROM rows_),
l2 AS (SELECT *, coalesce(list_position(list_transform(parts, lambda s: contains(s, said_)), true), 0) AS hit FROM l)
SELECT seq, 'claim-' || seq AS claim_id, claim_text, claim_text AS source_sentence, label, CASE label WHEN 'True' THEN 'True. DB vote record shows the ' || party_name || ' voted ' || said ELSE 'False. DB vote record shows the ' || party_name || ' voted ' || said || ', not ' || other || ',' END
    || ' on that House vote question on ' || day || '.' AS explanation,
  'House vote question: "' || {_QF} || '" The ' || party_name || ' voted ' || said || ' on ' || day || '.' AS evidence_text, CAST(statement_id AS VARCHAR) AS source_statement_id, coalesce(CAST(document_id AS VARCHAR), '') AS source_document_id, coalesce(who_en, '') AS source_speaker,
  coalesce(strftime(source_date, '%Y-%m-%d'), '') AS source_date, CASE label WHEN 'True' THEN 'matched' ELSE 'contradicted' END AS match_status, CAST(bill_id AS VARCHAR) AS bill_id, coalesce(bill_number, '') AS bill_number, coalesce(bill_title, '') AS bill_title, coalesce(session_id, '') AS session_id,
  coalesce(CAST(parliamentnum AS VARCHAR), '') AS parliament_number, day AS vote_date, party_name, coalesce(result, '') AS vote_result, coalesce(CAST(yea_total AS VARCHAR), '') AS yea_total, coalesce(CAST(nay_total AS VARCHAR), '') AS nay_total, CASE label WHEN 'True' THEN '' ELSE 'vote_direction' END AS contradiction_field,
  '{{"bill_id":' || bill_id || ',"party_id":' || party_id || ',"partyvote_id":' || partyvote_id || ',"votequestion_id":' || votequestion_id || '}}' AS evidence_primary_ids, {_words_cut(_AROUND, 1200)} AS source_context_local,
  CASE label WHEN 'True' THEN said ELSE other END AS claim_vote_direction, said AS evidence_vote_direction, CASE label WHEN 'True' THEN 'SUPPORTED' ELSE 'CONTRADICTED' END AS verdict_relation FROM l2 WHERE hit > 0""")
def v_p9_w1_vote_rows(spark, d):
    rows = votes.vote_rows(*_matched(spark, d))
    return rows.drop("source_context", "claim_origin", "source_table", "source_party", "claim_family", "claim_type", "claim_subtype", "session_number", "votequestion_id", "party_id", "politician_id", "politician_name", "evidence_source_tables", "evidence_json", "rule_id", "confidence", "parser_version", "generated_at", "notes", "votequestion_description")


@query()
def pipeline_vote_dataset(spark, d):
    """Entry point A: matched claims with synthetic negatives, deduplicated and valid."""
    rows, _ = pipelines.vote_dataset(_spoken(spark, d), _facts(spark, d), _patterns(spark, d), 1.0)
    return rows.drop("generated_at", "seq")


@query()
def pipeline_vote_stats(spark, d):
    return pipelines.vote_stats(*pipelines.vote_dataset(_spoken(spark, d), _facts(spark, d), _patterns(spark, d)))


def _gold_dataset(spark, d):
    meta = statements(spark, d, "bill_debated_id").withColumn("session_id", F.lit(None).cast("string"))
    return pipelines.gold_dataset(table(spark, d, "factcheck_master"), meta, bills(spark, d))


@query()
def pipeline_gold_pairs(spark, d):
    """Entry point B: the best candidate of every group as training pairs."""
    return pipelines.gold_pairs(_gold_dataset(spark, d)[0])


@query()
def pipeline_gold_stats(spark, d):
    return pipelines.gold_stats(*_gold_dataset(spark, d))


@query()
def pipeline_merged_pairs(spark, d):
    """Entry point C: silver pairs and a balanced choice of gold ones."""
    silver_rows = table(spark, d, "liar_silver_master").where("lower(label) in ('true', 'false')")
    silver_items = silver_rows.select(F.col("seq").alias("pair_id"), templates.silver_prompt().alias("prompt"), templates.silver_completion().alias("completion"), F.lower("label").alias("label"), "claim_type", "claim_text", F.lit("silver").alias("source_dataset"))
    return pipelines.merged_dataset(_items(spark, d), silver_items, {"true": 400, "false": 400})


_KEYED = f"rtrim(regexp_replace(lower({_squeeze('claim_text')}), '\\.$', ''))"


@query(f"""WITH v AS (
  SELECT seq, coalesce(trim(claim_text), '') = '' OR coalesce(trim(label), '') = '' AS e, label NOT IN ('True', 'False') OR label IS NULL AS b, label = 'False' AND coalesce(contradiction_field, '') = '' AS f,
    claim_origin = 'hansard_natural' AND claim_text IS DISTINCT FROM source_sentence AS t, NOT coalesce((label = 'True') = (verdict_relation = 'SUPPORTED'), true) AS r, {_KEYED} AS k, label, evidence_primary_ids AS ev FROM factcheck_master)
SELECT 'empty_field' AS violation, count(*) FILTER (WHERE e) AS n_rows FROM v UNION ALL SELECT 'bad_label', count(*) FILTER (WHERE b) FROM v UNION ALL SELECT 'false_without_field', count(*) FILTER (WHERE f) FROM v
UNION ALL SELECT 'text_differs', count(*) FILTER (WHERE t) FROM v UNION ALL SELECT 'relation_differs', count(*) FILTER (WHERE r) FROM v
UNION ALL SELECT 'label_conflict', count(*) FROM (SELECT k FROM v GROUP BY k HAVING count(DISTINCT label) > 1) UNION ALL SELECT 'duplicate_pair', count(*) FROM (SELECT k, ev FROM v GROUP BY ALL HAVING count(*) > 1)""")
def v_p2_row_contract(spark, d):
    return votes.violations(table(spark, d, "factcheck_master"), ["claim_text", "label"])


@query()
def v_p1_synthetic_negatives(spark, d):
    return votes.synthetic_negatives(table(spark, d, "factcheck_master"), 2.0).select("seq", "claim_id", "claim_text", "label", "contradiction_field", "explanation", "claim_vote_direction")


# Windows ------------------------------------------------------------------------------------------------------------


@query(f"""WITH k AS (SELECT seq, {_KEYED} AS ck, label, coalesce(evidence_primary_ids, '') AS ev FROM factcheck_master),
w AS (SELECT *, first_value(label) OVER (PARTITION BY ck ORDER BY seq) AS won FROM k), a AS (SELECT *, label IS NOT DISTINCT FROM won AS agrees FROM w)
SELECT seq, CASE WHEN NOT agrees THEN 'conflict' WHEN row_number() OVER (PARTITION BY ck, agrees, ev ORDER BY seq) > 1 THEN 'duplicate' END AS reason FROM a""")
def w3_first_label(spark, d):
    return records.first_label(table(spark, d, "factcheck_master"), "claim_text", "label", ["evidence_primary_ids"]).select("seq", "reason")


def _gold_scored(spark, d):
    meta = statements(spark, d, "bill_debated_id").withColumn("session_id", F.lit(None).cast("string"))
    return gold.with_metadata(table(spark, d, "factcheck_master"), meta, bills(spark, d)).withColumn("score", gold.candidate_score())


_DAY = "try_strptime(substr({0}, 1, 10), '%Y-%m-%d')::DATE"


def _near_sql(event: str, reach: int, penalty: int | None) -> str:
    days = f"date_diff('day', {event}, {_DAY.format('source_date')})"
    late = "0" if penalty is None else f"-({penalty} + least(abs({days}), 365))"
    return f"CASE WHEN {days} IS NULL THEN 0 WHEN {days} >= 0 THEN greatest(0, {reach} - least({days}, {reach})) ELSE {late} END"


_GOLD = f"""WITH {_ST}, {_BI}, f AS (SELECT *, CASE WHEN regexp_matches(source_statement_id, '^[ ]*[0-9]+[ ]*$') THEN try_cast(trim(source_statement_id) AS BIGINT) END AS sid, CASE WHEN regexp_matches(bill_id, '^[ ]*[0-9]+[ ]*$') THEN try_cast(trim(bill_id) AS BIGINT) END AS bid FROM factcheck_master),
s AS (
  SELECT seq, f.source_statement_id, claim_text, claim_type,
    CASE WHEN st.bill_debated_id = f.bid THEN 1000 ELSE 0 END
    + CASE WHEN regexp_extract(claim_text, {_lit(P.ORDINALS)}, 1) = '' OR claim_text IS NULL THEN 0 WHEN regexp_extract(claim_text, {_lit(P.ORDINALS)}, 2) = coalesce(parliament_number, '') AND regexp_extract(claim_text, {_lit(P.ORDINALS)}, 1) = coalesce(session_number, '') THEN 450 ELSE -450 END
    + {_near_sql(_DAY.format('vote_date'), 180, 240)} + {_near_sql('bi.introduced', 120, 160)} + {_near_sql('bi.latest_debate_date', 40, None)}
    + CASE WHEN claim_type = 'party_vote_direction' AND {_DAY.format('vote_date')} IS NOT NULL THEN 50 WHEN claim_type IN ('introduced_date', 'status_snapshot', 'session_parliament', 'sponsor') THEN 30 ELSE 0 END AS score
  FROM f LEFT JOIN st ON f.sid = st.id LEFT JOIN bi ON f.bid = bi.id
)"""


@query(_GOLD + " SELECT seq, score FROM s")
def m1_x17_gold_scores(spark, d):
    return _gold_scored(spark, d).select("seq", F.col("score").cast("long").alias("score"))


@query(_GOLD + """, g AS (SELECT claim_text, claim_type, count(*) AS n, max(score) AS best, count(*) FILTER (WHERE score = m) AS ties, min(seq) FILTER (WHERE score = m) AS seq
  FROM (SELECT *, max(score) OVER (PARTITION BY claim_text, claim_type) AS m FROM s) GROUP BY ALL)
SELECT claim_text, claim_type, seq, n AS n_candidates, CASE WHEN n = 1 THEN 'single_candidate' WHEN ties > 1 THEN 'score_tie' WHEN best < 0 THEN 'negative_best_score' ELSE 'scored_resolution' END AS method, CASE WHEN n = 1 THEN 0 ELSE best END AS score FROM g""")
def w2_gold_resolution(spark, d):
    return gold.resolve_groups(_gold_scored(spark, d), ["claim_text", "claim_type"]).select("claim_text", "claim_type", "seq", "n_candidates", "method", F.col("score").cast("long").alias("score"))


@query(_GOLD + f""", {_X26}, g AS (SELECT claim_text, claim_type, count(*) AS n, max(score) AS best, count(*) FILTER (WHERE score = m) AS ties, min(seq) FILTER (WHERE score = m) AS seq
  FROM (SELECT *, max(score) OVER (PARTITION BY claim_text, claim_type) AS m FROM s) GROUP BY ALL)
SELECT g.seq, x26 AS source_context_local, 'gold' AS dataset_tier, 'deterministic_db_rule' AS label_source, CASE WHEN n = 1 THEN 'single_candidate' ELSE 'scored_resolution' END AS gold_resolution_method, '' AS source_session_id, coalesce(CAST(st.bill_debated_id AS VARCHAR), '') AS source_bill_debated_id
FROM g JOIN x26 USING (seq) JOIN f ON g.seq = f.seq LEFT JOIN st ON f.sid = st.id WHERE n = 1 OR (ties = 1 AND best >= 0)""")
def v_p10_gold_rows(spark, d):
    scored = cut(_gold_scored(spark, d))
    chosen = gold.resolve_groups(scored, ["claim_text", "claim_type"]).where("kept").select("seq", "method")
    return gold.enrich(scored.join(chosen, "seq")).select("seq", *[c for c in gold.GOLD_COLUMNS if c != "gold_resolution_score"])


def _candidates(spark, d):
    c = table(spark, d, "liar_silver_master").select("seq", X.or_empty("claim_text").alias("claim_text"), X.claim_type("claim_text").alias("claim_type"))
    return c.withColumn("score", X.candidate_score("claim_text", "claim_type"))


@query(f"""WITH c AS (SELECT seq, coalesce(claim_text, '') AS claim_text, {_type_sql(_CT)} AS claim_type FROM liar_silver_master), s AS (SELECT *, {_candidate_sql('claim_text', 'claim_type')} AS score FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY claim_type ORDER BY score DESC, length(claim_text) DESC, seq) AS rn FROM s) SELECT seq, claim_type, rn FROM r ORDER BY rn, claim_type LIMIT 60""")
def w4_round_robin(spark, d):
    return silver.diverse(_candidates(spark, d), 60).select("seq", "claim_type", "rn")


@query(f"""SELECT min(seq) AS seq FROM liar_silver_master WHERE {_mk('claim_text')} <> '' GROUP BY {_mk('claim_text')}""")
def w6_first_per_key(spark, d):
    return records.distinct_claims(table(spark, d, "liar_silver_master")).select("seq")


@query("""WITH r AS (SELECT seq, row_number() OVER (ORDER BY seq) AS rn, coalesce(sum(length(coalesce(claim_text, ''))) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM liar_silver_master)
SELECT seq, rn FROM r WHERE rn = 1 OR before < 20000""")
def w7_prefix(spark, d):
    rows = table(spark, d, "liar_silver_master").select("seq", F.length(X.or_empty("claim_text")).alias("n"))
    return silver.prefix_until(rows, "n", ["seq"], 20000).select("seq", "rn")


@query("""WITH o AS (SELECT seq, lower(label) IN ('true', 'false') AS accepted, label_confidence IS NULL AS error FROM liar_silver_master WHERE label IS NOT NULL),
a AS (SELECT *, coalesce(sum(CAST(accepted AS INT)) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS na FROM o), b AS (SELECT * FROM a WHERE na < 100),
c AS (SELECT *, coalesce(sum(CAST(NOT error AS INT)) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nc FROM b) SELECT seq FROM c WHERE nc < 200""")
def w8_call_budget(spark, d):
    rows = table(spark, d, "liar_silver_master").where("label is not null").select("seq", F.lower("label").isin("true", "false").alias("accepted"), F.col("label_confidence").isNull().alias("error"))
    return silver.calls_until(rows, ["seq"], 100, 200).select("seq")


_X21 = f"""CASE WHEN n BETWEEN 60 AND 220 THEN 4 WHEN n BETWEEN 45 AND 320 THEN 2 ELSE -4 END + CASE WHEN regexp_matches(t, {_lit(P.GOLD_BILL_CODE)}) THEN 2 ELSE 0 END + CASE WHEN regexp_matches(t, '\\b\\d{{4}}\\b') THEN 1 ELSE 0 END
  + CASE WHEN regexp_matches(t, {_lit(P.GOLD_STAGES)}) THEN 1 ELSE 0 END + CASE WHEN m <= 2200 THEN 1 WHEN m > 3000 THEN -1 ELSE 0 END + CASE WHEN year >= 2020 THEN 2 WHEN year >= 2010 THEN 1 ELSE 0 END - CASE WHEN claim_type = 'party_vote_direction' THEN 1 ELSE 0 END"""
_BALANCED = f"""WITH ms AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY seq DESC) AS rn_ FROM factcheck_master WHERE claim_id IS NOT NULL) WHERE rn_ = 1),
taken AS (SELECT claim_text, lower(label) AS label FROM liar_silver_master WHERE lower(label) IN ('true', 'false')),
need AS (SELECT v.label, greatest(0, 400 - (SELECT count(*) FROM taken WHERE taken.label = v.label)) AS need FROM (VALUES ('true'), ('false')) v(label)),
items AS (SELECT pair_id, lower(regexp_extract(coalesce(completion, ''), {_lit(P.VERDICT_TOKEN)}, 1)) AS label, ms.claim_text, claim_type, coalesce(ms.claim_text, '') AS t, length(coalesce(ms.claim_text, '')) AS n, length(coalesce(prompt, '')) AS m,
  CASE WHEN regexp_matches(coalesce(source_date, ''), '^[0-9]{{4}}') THEN CAST(substr(source_date, 1, 4) AS INT) ELSE 0 END AS year FROM training_pairs p JOIN ms ON regexp_replace(p.metadata.claim_id, '^[a-z]+-', 'claim-') = ms.claim_id),
good AS (SELECT *, {_X21} AS s1 FROM items WHERE label IN ('true', 'false') AND n BETWEEN 45 AND 320 AND NOT {_any("t", P.MERGE_LOW_SIGNAL)} AND NOT EXISTS (SELECT 1 FROM taken WHERE {_mk('taken.claim_text')} = {_mk('items.claim_text')})),
cap AS (SELECT label, claim_type, count(*) AS c FROM good GROUP BY ALL),
rare AS (SELECT label, claim_type, least(c, need) AS q, CASE claim_type WHEN '{P.RARE_TYPES[0]}' THEN 0 ELSE 1 END AS pr FROM cap JOIN need USING (label) WHERE claim_type IN {P.RARE_TYPES}),
rest AS (SELECT label, greatest(0, need - coalesce((SELECT sum(q) FROM rare WHERE rare.label = need.label), 0)) AS l FROM need),
maj AS (SELECT rest.label, w.claim_type, weight, ord, l, coalesce(c, 0) AS c, least(coalesce(c, 0), CAST(floor(l * weight) AS BIGINT)) AS q0 FROM rest CROSS JOIN (VALUES {", ".join(f"('{k}', CAST({w} AS DOUBLE), {i})" for i, (k, w) in enumerate(P.MAJOR_WEIGHTS.items()))}) w(claim_type, weight, ord) LEFT JOIN cap ON cap.label = rest.label AND cap.claim_type = w.claim_type),
units AS (SELECT label, claim_type, row_number() OVER (PARTITION BY label ORDER BY weight DESC, c - q0 - u DESC, ord) AS r FROM (SELECT *, unnest(range(0, c - q0)) AS u FROM maj)),
extra AS (SELECT units.label, units.claim_type, count(*) AS e FROM units JOIN (SELECT label, max(l) - sum(q0) AS spare FROM maj GROUP BY label) z ON z.label = units.label WHERE r <= spare GROUP BY ALL),
quota AS (SELECT label, claim_type, q, pr FROM rare UNION ALL SELECT maj.label, maj.claim_type, q0 + coalesce(e, 0), 2 + ord FROM maj LEFT JOIN extra ON extra.label = maj.label AND extra.claim_type = maj.claim_type),
ranked AS (SELECT *, row_number() OVER (PARTITION BY label, claim_type ORDER BY s1 DESC, year DESC, m, n, pair_id) AS rn FROM good),
placed AS (SELECT pair_id, ranked.label, ranked.claim_type, row_number() OVER (PARTITION BY ranked.label ORDER BY pr, rn) AS place FROM ranked JOIN quota ON quota.label = ranked.label AND quota.claim_type = ranked.claim_type WHERE rn <= q)
SELECT pair_id, placed.label, claim_type, place FROM placed JOIN need ON need.label = placed.label WHERE place <= need"""


@query(_BALANCED)
def w10_w11_w12_x21_balanced(spark, d):
    taken = table(spark, d, "liar_silver_master").select("claim_text", F.lower("label").alias("label")).where("label in ('true', 'false')")
    return merge.select_balanced(_items(spark, d), taken, {"true": 400, "false": 400}).select("pair_id", "label", "claim_type", "place")


@query("SELECT seq, row_number() OVER (ORDER BY source_date NULLS FIRST, seq) AS rn FROM factcheck_master")
def w1_global_rank(spark, d):
    rows = table(spark, d, "factcheck_master").select("seq", "source_date")
    return ranking.global_rank(rows, [F.asc_nulls_first("source_date"), F.asc("seq")], "rn").select("seq", "rn")


# Aggregates ---------------------------------------------------------------------------------------------------------


@query("SELECT count(*) AS total_statements, min(CAST(time AS DATE)) AS first_day, max(CAST(time AS DATE)) AS last_day, count(DISTINCT who_en) FILTER (WHERE who_en <> '') AS speakers FROM hansards_statement")
def a1_a2_a3_debate_stats(spark, d):
    return metrics.debate_stats(table(spark, d, "hansards_statement"))


@query("""SELECT 1 AS section_no, 'label' AS category, coalesce(label, '') AS name, CAST(count(*) AS VARCHAR) AS value FROM liar_silver_master GROUP BY label
UNION ALL SELECT 2, 'claim_type', coalesce(claim_type, ''), CAST(count(*) AS VARCHAR) FROM liar_silver_master GROUP BY coalesce(claim_type, '')""")
def a4_a7_stats(spark, d):
    return metrics.long_counts(table(spark, d, "liar_silver_master").withColumn("label", X.or_empty("label")), ["label", "claim_type"])


@query("""SELECT 9 AS section_no, CASE WHEN contains(name, '.') THEN split_part(name, '.', 1) ELSE 'counter' END AS category, CASE WHEN contains(name, '.') THEN substr(name, instr(name, '.') + 1) ELSE name END AS name, CAST(value AS VARCHAR) AS value
FROM (SELECT CASE WHEN label = 'True' THEN 'kept.' || coalesce(claim_type, '') || '.x' ELSE coalesce(claim_type, '') END AS name, count(*) AS value FROM factcheck_master GROUP BY 1)""")
def a7_counter_rows(spark, d):
    kind = X.or_empty("claim_type")
    counters = table(spark, d, "factcheck_master").groupBy(F.when(F.col("label") == "True", F.concat(F.lit("kept."), kind, F.lit(".x"))).otherwise(kind).alias("name")).agg(F.count("*").alias("value"))
    return metrics.counter_rows(counters, 9)


@query("SELECT count(*) FILTER (WHERE label = 'True') AS n_true, count(*) FILTER (WHERE label = 'False') AS n_false, count(DISTINCT claim_type) + max(CASE WHEN claim_type IS NULL THEN 1 ELSE 0 END) AS kinds FROM factcheck_master")
def a5_a6_conditional_counts(spark, d):
    return table(spark, d, "factcheck_master").agg(F.count_if(F.col("label") == "True").alias("n_true"), F.count_if(F.col("label") == "False").alias("n_false"), metrics.distinct_with_null("claim_type").alias("kinds"))


@query("SELECT source_statement_id, claim_text, claim_type, count(*) AS n FROM factcheck_master GROUP BY ALL")
def a8_groups(spark, d):
    return table(spark, d, "factcheck_master").groupBy("source_statement_id", "claim_text", "claim_type").agg(F.count("*").alias("n"))


@query("SELECT min(pair_id) AS pair_id FROM training_pairs GROUP BY prompt, completion")
def a9_exact_duplicates(spark, d):
    return ranking.first_by(table(spark, d, "training_pairs"), ["prompt", "completion"], ["pair_id"]).select("pair_id")


@query(f"""WITH {_PA}, alias AS (SELECT lower(trim(name_en)) AS name FROM pa WHERE short_name_en <> '') SELECT seq, count(DISTINCT name) AS n_parties FROM factcheck_master LEFT JOIN alias ON contains(lower(claim_text), name) GROUP BY seq""")
def a10_j10_party_sets(spark, d):
    found = F.array_distinct(F.array_compact(F.array(*[F.when(F.lower("claim_text").rlike("(?i)" + p), F.lit(i).cast("bigint")) for p, i, _ in _patterns(spark, d)])))
    return table(spark, d, "factcheck_master").select("seq", F.when(F.col("claim_text").isNull(), 0).otherwise(F.size(found)).cast("long").alias("n_parties"))


@query("""WITH c AS (SELECT split, metadata.label AS label, count(*) AS n FROM training_pairs GROUP BY ALL) SELECT split, label, n, round_even(n / sum(n) OVER (PARTITION BY split), 3) AS share FROM c""")
def a11_shares(spark, d):
    return metrics.value_shares(table(spark, d, "training_pairs").select("split", F.col("metadata.label").alias("label")), ["split"], "label")


@query("""SELECT CAST(floor(quantile_cont(n, 0.5)) AS INT) AS p50, CAST(floor(quantile_cont(n, 0.9)) AS INT) AS p90, CAST(floor(quantile_cont(n, 0.95)) AS INT) AS p95, CAST(floor(quantile_cont(n, 0.99)) AS INT) AS p99, max(n) AS longest, count(*) FILTER (WHERE n > 1000) AS n_above,
  CAST(ceil(least(2048, greatest(1024, CAST(floor(quantile_cont(n, 0.99)) AS INT) + 64)) / 64) * 64 AS INT) AS cap FROM (SELECT length(prompt) AS n FROM training_pairs)""")
def a12_a13_m5_lengths(spark, d):
    rows = metrics.length_percentiles(table(spark, d, "training_pairs"), F.length("prompt").cast("long"), 1000)
    return rows.withColumn("cap", V.length_cap("p99"))


def _predictions(spark, d):
    return table(spark, d, "training_pairs").select("split", F.upper(F.coalesce("metadata.label", F.lit("INVALID"))).alias("gold"), F.coalesce(X.extract(X.or_empty("completion"), P.VERDICT_PREFIX), F.lit("INVALID")).alias("pred"))


_PRED = """WITH p AS (SELECT split, upper(coalesce(metadata.label, 'INVALID')) AS gold, coalesce(nullif(regexp_extract(coalesce(completion, ''), '(?m)^VERDICT:\\s*(TRUE|FALSE|MISLEADING|UNVERIFIED)', 1), ''), 'INVALID') AS pred FROM training_pairs),
l AS (SELECT gold AS label FROM p UNION SELECT pred FROM p),
r AS (SELECT label, (SELECT count(*) FROM p WHERE gold = label) AS support, (SELECT count(*) FROM p WHERE pred = label) AS np, (SELECT count(*) FROM p WHERE gold = label AND pred = label) AS h FROM l),
c AS (SELECT label, CASE WHEN np > 0 THEN h / np ELSE 0 END AS precision, CASE WHEN support > 0 THEN h / support ELSE 0 END AS recall, CASE WHEN h > 0 THEN 2.0 * h / (np + support) ELSE 0 END AS f1, support FROM r)
"""


@query(_PRED + "SELECT label, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM c")
def a17_class_report(spark, d):
    r = metrics.class_report(_predictions(spark, d), "gold", "pred")
    return r.select("label", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(_PRED + "SELECT (SELECT count(*) FROM p) AS n_rows, (SELECT round(avg(CAST(gold = pred AS INT)), 9) FROM p) AS accuracy, (SELECT round(avg(f1), 9) FROM c) AS macro_f1")
def a14_a15_a16_summary(spark, d):
    return metrics.summary(_predictions(spark, d), "gold", "pred").select("n_rows", F.round("accuracy", 9).alias("accuracy"), F.round("macro_f1", 9).alias("macro_f1"))


@query(_PRED + """SELECT row_no, actual, count(*) FILTER (WHERE pred = 'TRUE') AS pred_TRUE, count(*) FILTER (WHERE pred = 'FALSE') AS pred_FALSE, count(*) FILTER (WHERE pred = 'MISLEADING') AS pred_MISLEADING, count(*) FILTER (WHERE pred = 'UNVERIFIED') AS pred_UNVERIFIED, count(*) FILTER (WHERE pred = 'INVALID') AS pred_INVALID
FROM (VALUES (0, 'TRUE'), (1, 'FALSE'), (2, 'MISLEADING'), (3, 'UNVERIFIED'), (4, 'INVALID')) v(row_no, actual) LEFT JOIN p ON p.gold = v.actual GROUP BY ALL""")
def a18_confusion(spark, d):
    return metrics.confusion(_predictions(spark, d), "gold", "pred", ("TRUE", "FALSE", "MISLEADING", "UNVERIFIED", "INVALID"))


def _split_metrics(name: str) -> str:
    of = _PRED.replace("FROM training_pairs)", f"FROM training_pairs WHERE split = '{name}')")
    return f"({of} SELECT (SELECT avg(CAST(gold = pred AS INT)) FROM p) AS accuracy, (SELECT avg(f1) FROM c) AS macro_f1)"


@query(f"""SELECT metric, round(base, 9) AS base, round(tuned, 9) AS tuned, round(tuned - base, 9) AS delta FROM (
  SELECT unnest(['accuracy', 'macro_f1']) AS metric, unnest([a.accuracy, a.macro_f1]) AS base, unnest([b.accuracy, b.macro_f1]) AS tuned FROM {_split_metrics("validation")} a, {_split_metrics("test")} b)""")
def a19_comparison(spark, d):
    rows = _predictions(spark, d)
    both = [metrics.summary(rows.where(F.col("split") == s), "gold", "pred") for s in ("validation", "test")]
    return metrics.compare(*both, ["accuracy", "macro_f1"]).select("metric", *[F.round(c, 9).alias(c) for c in ("base", "tuned", "delta")])


# Sorts, sets, samples -----------------------------------------------------------------------------------------------


@query("SELECT claim_id, source_date FROM factcheck_master ORDER BY source_date, claim_id")
def t5_text_order(spark, d):
    return table(spark, d, "factcheck_master").orderBy("source_date", "claim_id").select("claim_id", "source_date")


@query("SELECT seq, rn FROM (SELECT seq, row_number() OVER (ORDER BY length(coalesce(claim_text, '')) DESC, seq) AS rn FROM factcheck_master) WHERE rn <= 20")
def t6_t7_top(spark, d):
    rows = table(spark, d, "factcheck_master").select("seq", F.length(X.or_empty("claim_text")).alias("n")).orderBy(F.desc("n"), "seq").limit(20)
    return ranking.global_rank(rows, [F.desc("n"), F.asc("seq")], "rn").select("seq", "rn")


@query("SELECT seq, claim_text, bill_number, CAST(NULL AS VARCHAR) AS label_confidence FROM factcheck_master UNION ALL SELECT seq, claim_text, NULL, label_confidence FROM liar_silver_master")
def u1_union(spark, d):
    a = table(spark, d, "factcheck_master").select("seq", "claim_text", "bill_number")
    return a.unionByName(table(spark, d, "liar_silver_master").select("seq", "claim_text", "label_confidence"), allowMissingColumns=True)


@query("SELECT DISTINCT CASE WHEN regexp_matches(bill_id, '^[ ]*[0-9]+[ ]*$') THEN try_cast(trim(bill_id) AS BIGINT) END AS id FROM factcheck_master WHERE CASE WHEN regexp_matches(bill_id, '^[ ]*[0-9]+[ ]*$') THEN try_cast(trim(bill_id) AS BIGINT) END <> 0")
def u2_distinct_ids(spark, d):
    return table(spark, d, "factcheck_master").select(V.whole_number("bill_id").alias("id")).where("id <> 0").distinct()


@query("""SELECT claim_id, claim_text FROM factcheck_master WHERE seq % 2 = 0 UNION ALL SELECT n.claim_id, n.claim_text FROM factcheck_master n WHERE seq % 2 = 1 AND NOT EXISTS (SELECT 1 FROM factcheck_master e WHERE e.seq % 2 = 0 AND e.claim_id = n.claim_id)""")
def u4_k5_upsert(spark, d):
    rows = table(spark, d, "factcheck_master")
    return records.upsert(rows.where("seq % 2 = 0").select("claim_id", "claim_text"), rows.where("seq % 2 = 1").select("claim_id", "claim_text"), "claim_id")


_U6 = """WITH r AS (SELECT seq, lower(label) AS label FROM liar_silver_master), m AS (SELECT * FROM r WHERE label IN ('mostly-true', 'half-true', 'barely-true', 'pants-fire')), f AS (SELECT * FROM r WHERE label IN ('true', 'false'))"""


@query(_U6 + " SELECT * FROM m UNION ALL (SELECT * FROM f ORDER BY seq LIMIT (SELECT greatest(0, 400 - count(*)) FROM m))")
def u6_middle_first(spark, d):
    rows = table(spark, d, "liar_silver_master").select("seq", F.lower("label").alias("label"))
    return records.by_label_priority(rows, "label", P.MIDDLE_LABELS, P.FALLBACK_LABELS, ["seq"], 400, "middle_first")


@query("""WITH n AS (SELECT source_dataset, count(*) AS n FROM training_pairs GROUP BY ALL), a AS (SELECT 'p4' AS kind, source_dataset, n, unnest(['train', 'validation', 'test']) AS part, unnest([round(n * 0.8), round(n * 0.9) - round(n * 0.8), n - round(n * 0.9)]) AS k FROM n
  UNION ALL SELECT 'p3', source_dataset, n, unnest(['train', 'test']), unnest([round(n * 0.9), n - round(n * 0.9)]) FROM n)
SELECT kind, source_dataset, part, CAST(k AS BIGINT) AS n, CAST(k AS BIGINT) AS n_pairs, true AS rows_whole FROM a WHERE k > 0""")
def v_p3_p4_t9_stratified(spark, d):
    """Sizes of every part of every stratum, by rows and by distinct pairs; the parts together are the whole table."""
    rows = table(spark, d, "training_pairs")
    total = rows.count()
    cuts = (("p4", {"train": 0.8, "validation": 0.1, "test": 0.1}, 3407), ("p3", {"train": 0.9, "test": 0.1}, 42))
    dealt = [sampling.stratified(rows.select("pair_id", "source_dataset"), ["source_dataset"], "pair_id", parts, seed).select(F.lit(kind).alias("kind"), "source_dataset", F.col("split").alias("part"), "pair_id") for kind, parts, seed in cuts]
    both = cut(dealt[0].unionByName(dealt[1]))
    whole = both.groupBy("kind").agg((F.countDistinct("pair_id") == total).alias("rows_whole"))
    return both.groupBy("kind", "source_dataset", "part").agg(F.count("*").alias("n"), F.countDistinct("pair_id").alias("n_pairs")).join(whole, "kind")


@query("SELECT seq, claim_id, substr(claim_text, 1, 60) AS shown FROM factcheck_master ORDER BY seq LIMIT 5")
def t8_first_rows(spark, d):
    return table(spark, d, "factcheck_master").orderBy("seq").limit(5).select("seq", "claim_id", F.substring("claim_text", 1, 60).alias("shown"))


@query("""SELECT 'prompt' AS "column", count(*) FILTER (WHERE prompt IS NULL) AS n_null FROM training_pairs UNION ALL SELECT 'completion', count(*) FILTER (WHERE completion IS NULL) FROM training_pairs""")
def v_p5_null_checks(spark, d):
    rows = table(spark, d, "training_pairs")
    if metrics.missing_columns(rows, ["prompt", "completion"]):
        raise ValueError("columns are missing")
    return metrics.null_counts(rows, ["prompt", "completion"])


def _usable_sql(x: str) -> str:
    return f"(length({x}) BETWEEN 30 AND 420 AND NOT {_any(x, P.SILVER_LOW_SIGNAL)} AND {_any(x, P.SILVER_FACTS)})"


@query(f"""WITH {_ST}, seeds AS (SELECT 0 AS part, seq AS k, 0 AS pos, CAST(NULL AS BIGINT) AS statement_id, claim_text FROM factcheck_master WHERE {_usable_sql(_stripped("coalesce(claim_text, '')"))}),
taken AS (SELECT DISTINCT {_mk("claim_text")} AS mk FROM liar_silver_master),
have AS (SELECT count(DISTINCT {_mk("claim_text")}) AS n FROM seeds WHERE {_mk("claim_text")} <> '' AND {_mk("claim_text")} NOT IN (SELECT mk FROM taken)),
sp AS (SELECT id, list_filter({_sentences_sql(_stripped("regexp_replace(coalesce(content_en, ''), '<[^>]+>', '', 'g')"))}, lambda s: {_usable_sql("s")}) AS parts FROM st WHERE NOT coalesce(procedural, false)),
cand AS (SELECT 1 AS part, id AS k, unnest(range(0, len(parts))) AS pos, id AS statement_id, unnest(parts) AS claim_text FROM sp),
per AS (SELECT statement_id, count(*) AS c FROM cand GROUP BY 1),
pr AS (SELECT statement_id, row_number() OVER (ORDER BY statement_id) AS rn, coalesce(sum(c) OVER (ORDER BY statement_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM per),
used AS (SELECT statement_id FROM pr, have WHERE n < 900 AND (rn = 1 OR b + n < 3600)),
every AS (SELECT * FROM seeds UNION ALL SELECT * FROM cand WHERE statement_id IN (SELECT statement_id FROM used)),
firsts AS (SELECT * FROM (SELECT *, {_mk("claim_text")} AS mk, row_number() OVER (PARTITION BY {_mk("claim_text")} ORDER BY part, k, pos) AS f FROM every) WHERE f = 1 AND mk <> '' AND mk NOT IN (SELECT mk FROM taken)),
kinds AS (SELECT *, {_type_sql("claim_text")} AS claim_type FROM firsts), scores AS (SELECT *, {_candidate_sql("claim_text", "claim_type")} AS score FROM kinds),
r AS (SELECT *, row_number() OVER (PARTITION BY claim_type ORDER BY score DESC, length(claim_text) DESC, part, k, pos) AS rn FROM scores)
SELECT statement_id, CASE part WHEN 1 THEN pos END AS pos, claim_text, claim_type, score, rn FROM r ORDER BY rn, claim_type LIMIT 900""")
def v_p6_candidate_pool(spark, d):
    # masters' claims are the seeds; too few of them are left, so sentences of statements are added
    rows = statements(spark, d, "document_id", "time", "who_en", "h1_en", "h2_en", "h3_en", "content_en", "procedural")
    kinded = table(spark, d, "factcheck_master").where(X.usable_claim("claim_text")).select("seq", "claim_text", X.claim_type("claim_text").alias("claim_type"))
    seeds = kinded.withColumn("score", X.candidate_score("claim_text", "claim_type")).withColumn("statement_id", F.lit(None).cast("long")).withColumn("pos", F.lit(None).cast("int"))
    pool = silver.candidate_pool(seeds, rows.where(~F.coalesce("procedural", F.lit(False))), table(spark, d, "liar_silver_master"), 900)
    return pool.select("statement_id", "pos", "claim_text", "claim_type", "score", "rn")


#: Answers of a stand-in model, one for every guard and two that pass, by the number of the row.
_ANSWERS = (
    '{"accept": true, "label": "half-true", "confidence": 0.8, "not_binary_reason": "mixed", "rationale": "as recorded", "evidence_summary": "the record", "used_sources": [{"title": "r", "url": "https://www.ourcommons.ca/x"}]}',
    '```json\n{"accept": true, "label": " TRUE ", "confidence": 75, "rationale": "as recorded", "evidence_summary": "the record", "used_sources": [{"title": "r", "url": "https://www.parl.ca/x"}, {"title": "s", "url": "https://example.org"}]}\n```',
    '{"accept": false, "reason": "unclear"}',
    '{"accept": true, "label": "maybe", "confidence": 90, "rationale": "a", "evidence_summary": "b", "used_sources": [{"title": "r", "url": "https://www.parl.ca/x"}]}',
    '{"accept": true, "label": "true", "confidence": 0.2, "rationale": "a", "evidence_summary": "b", "used_sources": [{"title": "r", "url": "https://www.parl.ca/x"}]}',
    '{"accept": true, "label": "true", "confidence": 90, "rationale": " ", "evidence_summary": "b", "used_sources": [{"title": "r", "url": "https://www.parl.ca/x"}]}',
    '{"accept": true, "label": "false", "confidence": 90, "rationale": "a", "evidence_summary": "b", "used_sources": [{"title": "r", "url": "https://example.org/parl.ca"}]}',
    '{"accept": true, "label": "mostly-true", "confidence": 90, "rationale": "a", "evidence_summary": "b", "used_sources": [{"title": "r", "url": "https://www.parl.ca/x"}]}',
    "no JSON at all",
)
_REASONS = (None, None, "not_accepted", "bad_label", "low_confidence", "no_evidence", "no_official_source", "no_middle_reason", "not_accepted")
_LABELS = ("half-true", "true", "", "maybe", "true", "true", "false", "mostly-true", "")


def _by_number(values) -> str:
    return "CASE seq % 9 " + " ".join(f"WHEN {k} THEN {_lit(v)}" for k, v in enumerate(values) if v is not None) + " END"


@query(f"""SELECT 'silver_' || substr(sha1(coalesce(claim_text, '') || '|' || coalesce(source_statement_id, '') || '|' || coalesce(source_date, '')), 1, 12) AS claim_id, claim_text, coalesce(source_context, '') AS source_context, coalesce(source_speaker, '') AS source_speaker,
  coalesce(source_date, '') AS source_date, coalesce(source_topic_h1, '') AS source_topic_h1, coalesce(nullif(claim_type, ''), 'general') AS claim_type, 'silver' AS dataset_tier, 'liar_silver_v2_middle_first' AS prompt_version, seq,
  nullif({_by_number(_LABELS)}, '') AS label, {_by_number(("80", "75", "", "90", "20", "90", "90", "90", ""))} AS label_confidence, {_by_number(_REASONS)} AS reason,
  {_hard_cut("CASE WHEN b <> '' AND local <> '' THEN 'Hansard context: ' || local || ' Official evidence: ' || b ELSE coalesce(nullif(b, ''), local) END", 900)} AS evidence_text
FROM (SELECT *, coalesce(source_context_local, '') AS local, {_by_number(("the record", "the record", "", "b", "b", "b", "b", "b", ""))} AS b FROM liar_silver_master)""")
def f16_v_p12_silver_rows(spark, d):
    def make():
        return lambda prompts: [_ANSWERS[int(p) % len(_ANSWERS)] for p in prompts]

    rows = table(spark, d, "liar_silver_master").select("seq", "claim_text", F.col("source_statement_id").alias("statement_id"), F.col("source_date").alias("date"), "source_context_local", F.col("source_context").alias("full_context"), F.col("source_speaker").alias("speaker"), F.col("source_topic_h1").alias("h1_en"), "claim_type")
    labelled = silver.label_rows(boundaries.call_model(rows.withColumn("number", F.col("seq").cast("string")), "number", make))
    return labelled.select("claim_id", "claim_text", "source_context", "source_speaker", "source_date", "source_topic_h1", "claim_type", "dataset_tier", "prompt_version", "seq", "label", "label_confidence", "reason", "evidence_text")


@query()
def pipeline_silver_rows(spark, d):
    """The silver pipeline with a stand-in model: pool, labels, budget, priority, existing rows first."""

    def make():
        return lambda prompts: [_ANSWERS[len(p) % len(_ANSWERS)] for p in prompts]

    content = statements(spark, d, "document_id", "time", "who_en", "h1_en", "h2_en", "h3_en", "content_en", "procedural").where(~F.coalesce("procedural", F.lit(False)))
    taken = table(spark, d, "liar_silver_master")
    none = silver.candidate_claims(content.limit(0)).withColumn("seq", F.lit(0).cast("long"))
    pool = silver.candidate_pool(none, content, taken, 900).join(content.select(F.col("id").alias("statement_id"), X.clean("content_en").alias("full_context")), "statement_id")
    return pipelines.silver_dataset(pool, make, taken)[0].drop("generated_at")


@query("SELECT coalesce(nullif(metadata.claim_id, ''), 'item_' || CAST(pair_id AS VARCHAR)) AS claim_id, completion AS ground_truth, length(coalesce(prompt, '')) AS prompt_length FROM training_pairs")
def v_p8_inference_rows(spark, d):
    return boundaries.inference_rows(table(spark, d, "training_pairs"))
