"""The library's queries over the synthetic tables, with the DuckDB SQL that gives the same rows.

Searches take as queries every row whose id is divisible by 50, against all rows. Distances are rounded to 6 digits
before they are ranked.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import identity as I
from lodestone.functions import sentences as S
from lodestone.functions import text as T
from lodestone.operators import chunking as C
from lodestone.operators import evaluation as V
from lodestone.operators import judging as J
from lodestone.operators import retrieval as R
from lodestone.runtime import query
from lodestone.plans import diagnostics as D
from lodestone.sources import cache as K
from lodestone.sources.config import Profile
from lodestone.sources.index import problems_table
from lodestone.sources.storage import scratch, written
from lodestone.sources.vectors import VectorIndex

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: DuckDB's form of functions.text.WHITE.
_WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_BLANK = r"[\t-\r ]"
FINGERPRINT = I.fingerprint({"catalogue": 1})
RAW, FINAL, NEAR = 10, 5, 0.02
SPACE_CUTOFF = 0.75
LABELS = {"src0": "Main source", "src1": "Second source"}
SECTION = "(?m)^(?=[A-E])"
TOPIC_WORDS = ["the", "that", "en", "der", "que"]


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = query(f)
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _each(function: Callable, returns: str, *columns):
    """A rule of the chunker for each row, as the chunker applies it; nulls give null."""

    @F.pandas_udf(returns)
    def run(*given: pd.Series) -> pd.Series:
        return pd.Series([None if row[0] is None else function(*row) for row in zip(*given, strict=True)], dtype=object)

    return run(*columns)


def _squeezed(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{_WS}+', ' ', 'g'))"


def _stripped(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _content_key(x: str) -> str:
    return f"CASE WHEN {_squeezed(f'nfc_normalize({x})')} <> '' THEN sha256({_squeezed(f'nfc_normalize({x})')}) END"


def _sha_vector(x: str) -> str:
    return "[" + ", ".join(f"(('0x' || substr(sha256({x}), {2 * i + 1}, 2))::INT + 1) / 256.0::DOUBLE" for i in range(8)) + "]"


def _distance(a: str, b: str) -> str:
    return f"round(1 - list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[]), 6)"


# -- vectors ---------------------------------------------------------------------------------------------------------


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "embeddings")
    return rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), rows.select(F.col("vec_id").alias("id_num"), "embedding")


_HITS = f"""
    WITH d AS (SELECT q.vec_id AS query_id, c.vec_id AS id_num, q.label AS query_label, c.label AS label, {_distance("q.embedding", "c.embedding")} AS distance
               FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id_num) AS INT) AS rank FROM d),
    h AS (SELECT * FROM r WHERE rank <= {RAW})
"""


@register(_HITS + "SELECT query_id, rank, id_num, distance FROM h")
def vector_topk(spark, sf_dir):
    return R.top_k(*_vectors(spark, sf_dir), RAW, exclude_self=True)


@register(_HITS + "SELECT query_id, rank, id_num, distance FROM h")
def vector_index_topk(spark, sf_dir):
    """The same from a stored index of clusters, of which those too far away are not read."""
    queries, rows = _vectors(spark, sf_dir)
    index = VectorIndex(spark, str(scratch(spark) / f"vector-index-{uuid.uuid4().hex}"))
    index.build(rows, clusters=min(64, max(1, rows.count() // 32)))
    return index.search(queries, RAW, exclude_self=True).found


@register(_HITS + "SELECT query_id, id_num, distance FROM d")
def vector_distances(spark, sf_dir):
    queries, chunks = _vectors(spark, sf_dir)
    return R.all_distances(queries, chunks).where("query_id <> id_num")


@register(_HITS + f"SELECT query_id, id_num, distance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INT) AS number FROM h WHERE distance <= {SPACE_CUTOFF} QUALIFY number <= {FINAL}")
def vector_selection(spark, sf_dir):
    """The flagship: raw top-k, then the cutoff, distinct contents and the clamp."""
    hits = R.top_k(*_vectors(spark, sf_dir), RAW, exclude_self=True).withColumn("text", F.col("id_num").cast("string"))
    return R.select_context(hits, SPACE_CUTOFF, FINAL).select("query_id", "id_num", "distance", "number")


def _labelled_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    hits = vector_topk(spark, sf_dir).join(labels.withColumnRenamed("vec_id", "id_num"), "id_num")
    return hits.join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label")), "query_id")


@register(
    _HITS
    + """, g AS (SELECT CASE WHEN label = query_label THEN 'relevant' WHEN abs(label - query_label) = 1 THEN 'doubtful' ELSE 'irrelevant' END AS label, distance FROM h),
    a AS (SELECT label, count(*) AS n, min(distance) AS low, max(distance) AS high FROM g GROUP BY label)
    SELECT l.label, coalesce(n, 0) AS n, coalesce(printf('%.6f..%.6f', low, high), 'n/a') AS distances FROM (VALUES ('relevant'), ('doubtful'), ('irrelevant')) l(label) LEFT JOIN a USING (label)"""
)
def distance_range_by_label(spark, sf_dir):
    same, close = F.col("label") == F.col("query_label"), F.abs(F.col("label") - F.col("query_label")) == 1
    return V.distance_ranges(_labelled_hits(spark, sf_dir).withColumn("label", F.when(same, "relevant").when(close, "doubtful").otherwise("irrelevant")))


@register(_HITS + "SELECT query_id, avg(CAST(label = query_label AS INT)) AS precision FROM h GROUP BY query_id")
def precision_at_k(spark, sf_dir):
    return _labelled_hits(spark, sf_dir).groupBy("query_id").agg(F.avg((F.col("label") == F.col("query_label")).cast("int")).alias("precision"))


# -- documents as chunks, questions from conversations ---------------------------------------------------------------

_CONTEXT = f"""
    WITH c AS (SELECT doc_id AS id_num, text, source, lang, {_sha_vector("text")} AS v FROM documents),
    q AS (SELECT conv_id * 1000 + turn AS query_id, text AS query, {_sha_vector("text")} AS v FROM conversations WHERE role = 'user' AND conv_id % 50 = 0),
    d AS (SELECT query_id, query, id_num, text, source, lang, {_distance("q.v", "c.v")} AS distance FROM q, c),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id_num) AS rank FROM d QUALIFY rank <= {RAW}),
    k AS (SELECT *, {_content_key("text")} AS content_key FROM r WHERE distance <= {NEAR}),
    u AS (SELECT * FROM k WHERE content_key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY query_id, content_key ORDER BY rank) = 1),
    s AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS number FROM u QUALIFY number <= {FINAL})
"""


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").where("role = 'user' and conv_id % 50 = 0")
    return turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("query"))


def _selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id_num"), "text", F.col("source"), F.col("lang"))
    chunks = docs.select("id_num", T.sha_embedding(F.col("text")).alias("embedding"))
    hits = R.top_k(_questions(spark, sf_dir).select("query_id", T.sha_embedding(F.col("query")).alias("embedding")), chunks, RAW)
    described = docs.select("id_num", "text", "source", F.concat(F.lit("Source "), "source").alias("source_display"), F.col("lang").alias("source_kind"), F.lit("overview").alias("doc_type"), F.lit(0).alias("header_len"))
    chosen = R.select_context(hits.join(described, "id_num"), NEAR, FINAL)
    return chosen.withColumn("section_heading", _each(C.heading_of, "string", F.col("text")))


@register(_CONTEXT + "SELECT query_id, CAST(number AS INT) AS number, CAST(rank AS INT) AS rank, id_num, distance, content_key FROM s")
def select_context(spark, sf_dir):
    return _selected(spark, sf_dir).select("query_id", "number", "rank", "id_num", "distance", "content_key")


@register(
    _CONTEXT
    + f"""SELECT q.query_id, count(s.id_num) AS n_context, count(s.id_num) = 0 AS insufficient_basis,
    CASE WHEN count(s.id_num) = 0 THEN CASE WHEN regexp_matches(q.query, '[А-Яа-яЁё]') THEN '{T.NO_BASIS["ru"]}' ELSE '{T.NO_BASIS["en"]}' END END AS answer
    FROM q LEFT JOIN s USING (query_id) GROUP BY q.query_id, q.query"""
)
def grounding_gate(spark, sf_dir):
    counts = _selected(spark, sf_dir).groupBy("query_id").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return _questions(spark, sf_dir).join(counts, "query_id", "left").select("query_id", n.alias("n_context"), (n == 0).alias("insufficient_basis"), F.when(n == 0, T.no_basis_answer(F.col("query"))).alias("answer"))


def _heading_sql(x: str) -> str:
    line = _stripped(f"split_part({_stripped(x)}, chr(10), 1)")
    return f"CASE WHEN length({line}) > {C.HEADING_CHARS} THEN left({line}, {C.HEADING_CHARS}) || '…' ELSE {line} END"


def _attribute_sql(x: str) -> str:
    out = _squeezed(x)
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        out = f"replace({out}, '{char}', '{name}')"
    return out


_BLOCK_SQL = f"""'<retrieved_fragment ' || concat_ws(' ', 'number="' || number || '"', 'source="' || {_attribute_sql("'Source ' || source")} || '"', 'type="' || {_attribute_sql("lang")} || '"',
    CASE WHEN {_heading_sql("text")} <> '' THEN 'heading="' || {_attribute_sql(_heading_sql("text"))} || '"' END) || '>' || chr(10) || replace(text, '<', '&lt;') || chr(10) || '</retrieved_fragment>'"""


@register(_CONTEXT + f"SELECT query_id, count(*) AS n_context, sha256(string_agg({_BLOCK_SQL}, chr(10) ORDER BY number)) AS context_sha256 FROM s GROUP BY query_id")
def fragment_prompt(spark, sf_dir):
    return R.context_block(_selected(spark, sf_dir)).select("query_id", "n_context", F.sha2("context", 256).alias("context_sha256"))


@register(
    _CONTEXT
    + f"""SELECT query_id, CAST(number AS INT) AS number, 'Source ' || source AS label, lang AS source_kind, 'overview' AS doc_type, {_heading_sql("text")} AS heading,
    CASE WHEN length({_stripped("text")}) > {T.SNIPPET_CHARS} THEN left({_stripped("text")}, {T.SNIPPET_CHARS}) || '...' ELSE {_stripped("text")} END AS snippet FROM s"""
)
def source_cards(spark, sf_dir):
    return R.source_cards(_selected(spark, sf_dir))


@register(
    _CONTEXT
    + """SELECT q.query_id, CASE WHEN contains(lower(q.query), 'tax') AND NOT bool_or(contains(lower(coalesce(s.text, '')), 'tax') OR contains(lower(coalesce(s.text, '')), 'vat')) THEN false
    ELSE count(s.id_num) > 0 END AS sufficient FROM q LEFT JOIN s USING (query_id) GROUP BY q.query_id, q.query"""
)
def sufficiency(spark, sf_dir):
    texts = _selected(spark, sf_dir).groupBy("query_id").agg(F.count("*").alias("n"), F.array_join(F.collect_list("text"), " ").alias("text"))  # FINAL texts at most
    joined = _questions(spark, sf_dir).join(texts, "query_id", "left")
    return joined.select("query_id", V.sufficient(F.coalesce("n", F.lit(0)), F.col("query"), F.col("text"), {"tax": ["tax", "vat"]}).alias("sufficient"))


# -- text rules over whole tables ------------------------------------------------------------------------------------


@register(f"SELECT doc_id, {_content_key('text')} AS content_key FROM documents")
def content_key(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.content_key(F.col("text")).alias("content_key"))


@register(f"SELECT content_key, count(*) AS copies, min(doc_id) AS first_id FROM (SELECT doc_id, {_content_key('text')} AS content_key FROM documents) WHERE content_key IS NOT NULL GROUP BY content_key HAVING count(*) > 1")
def duplicate_groups(spark, sf_dir):
    return content_key(spark, sf_dir).where("content_key is not null").groupBy("content_key").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


def _question_sql(x: str) -> str:
    return _stripped(f"regexp_replace(lower({_squeezed(x)}), '[?!.,…:;]+$', '')")


@register(f"SELECT conv_id, turn, sha256('{FINGERPRINT}||' || {_question_sql('text')}) AS cache_key FROM conversations")
def cache_key(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.question_key(F.col("text"), FINGERPRINT).alias("cache_key"))


@register(f"SELECT doc_id, row_number() OVER (PARTITION BY sha256('{FINGERPRINT}||' || {_question_sql('text')}) ORDER BY doc_id) > 1 AS from_cache FROM documents")
def cache_hit_simulation(spark, sf_dir):
    """Documents as questions in order of arrival: the first of a key misses, all later ones hit."""
    keyed = written(table(spark, sf_dir, "documents").select("doc_id", T.question_key(F.col("text"), FINGERPRINT).alias("key")), "keys")
    first = keyed.groupBy("key").agg(F.min("doc_id").alias("first"))
    return keyed.join(first, "key").select("doc_id", (F.col("doc_id") > F.col("first")).alias("from_cache"))


@register("SELECT conv_id, turn, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC) = 1")
def cache_latest(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", F.col("turn").alias("created_at"), F.col("text").alias("seq"))
    return K.latest(rows, "conv_id").select("conv_id", "turn", "role", "text")


@register("WITH r AS (SELECT ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1) SELECT count(*) AS entries, min(ts) AS oldest, max(ts) AS newest FROM r")
def cache_stats(spark, sf_dir):
    """Events as rows of a cache: those that a newer one of their key replaces don't count."""
    rows = table(spark, sf_dir, "events").select(F.struct("user_id", "event_type").alias("query_hash"), F.col("ts").alias("created_at"), F.col("event_id").alias("seq"))
    return K.cache_stats(K.latest(rows))


@register(
    f"""WITH s AS (SELECT DISTINCT {_question_sql('text')} AS q FROM documents)
    SELECT conv_id * 1000 + turn AS query_id, CASE WHEN s.q IS NOT NULL THEN 'answer of ' || length(s.q) END AS answer FROM conversations c LEFT JOIN s ON s.q = {_question_sql('c.text')}
    UNION ALL SELECT -1 - doc_id, 'answer of ' || length({_question_sql('text')}) FROM documents"""
)
def cache_lookup(spark, sf_dir):
    """Documents' texts are stored as answered questions; conversations and the documents, in capitals if they have no ß, are looked up."""
    docs = table(spark, sf_dir, "documents")
    cache = K.AnswerCache(spark, str(scratch(spark) / f"cache-{uuid.uuid4().hex}"), FINGERPRINT)
    stored = docs.select(F.col("text").alias("query"), F.concat(F.lit("answer of "), F.length(T.question_text(F.col("text"))).cast("string")).alias("answer"), F.array().cast(K.CONTEXT).alias("context"))
    cache.store(stored)
    louder = F.when(F.contains("text", F.lit("ß")), F.col("text")).otherwise(F.upper("text"))
    asked = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("query"))
    asked = asked.unionByName(docs.select((-1 - F.col("doc_id")).alias("query_id"), F.concat(F.lit("  "), louder, F.lit(" ")).alias("query")))
    return cache.lookup(asked).select("query_id", F.col("cached_answer").alias("answer"))


@register("SELECT doc_id, [text, 'src:' || source] AS texts, [CAST(NULL AS VARCHAR), source] AS sources FROM documents")
def cached_context(spark, sf_dir):
    """Stored context of two forms, a bare text and an object, read back as one."""
    docs = table(spark, sf_dir, "documents")
    item = F.to_json(F.struct(F.concat(F.lit("src:"), "source").alias("text"), F.create_map(F.lit("source"), F.col("source")).alias("metadata")))
    bare = F.regexp_extract(F.to_json(F.array("text")), r"^\[(.*)\]$", 1)
    context = K.normal_context(F.concat(F.lit("["), bare, F.lit(","), item, F.lit("]")))
    return docs.select("doc_id", context.alias("c")).select("doc_id", F.transform("c", lambda x: x["text"]).alias("texts"), F.transform("c", lambda x: F.element_at(x["metadata"], "source")).alias("sources"))


@register("SELECT doc_id, " + ", ".join(f"({_sha_vector('text')})[{i + 1}] AS e{i}" for i in range(8)) + " FROM documents")
def sha_embedding(spark, sf_dir):
    v = table(spark, sf_dir, "documents").select("doc_id", T.sha_embedding(F.col("text")).alias("v"))
    return v.select("doc_id", *(F.col("v")[i].alias(f"e{i}") for i in range(8)))


@register(f"SELECT doc_id, {_heading_sql('text')} AS heading FROM documents")
def section_heading(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", _each(C.heading_of, "string", F.col("text")).alias("heading"))


@register("WITH d AS (SELECT doc_id, list_transform(string_split(text, ''), lambda c: unicode(c)) AS p FROM documents) SELECT doc_id, " + ", ".join(f"coalesce(list_sum(list_filter(p, lambda x, i: i % 7 = {(i + 1) % 7})), 0) % 97 + 0.0::DOUBLE AS e{i + 1}" for i in range(7)) + " FROM d")
def code_point_embedding(spark, sf_dir):
    v = table(spark, sf_dir, "documents").select("doc_id", T.code_point_embedding(F.col("text")).alias("v"))
    return v.select("doc_id", *(F.col("v")[i].alias(f"e{i}") for i in range(1, 8)))


def _header_sql(heading: str) -> str:
    return f"('[Source: ' || source || ' | ' || CASE source WHEN 'src0' THEN 'Main source' WHEN 'src1' THEN 'Second source' ELSE source END || ']' || chr(10) || '[Section: ' || {heading} || ']' || chr(10) || chr(10))"


@register(
    f"""WITH a AS (SELECT doc_id, source, {_heading_sql("text")} AS h FROM documents), b AS (SELECT *, {_header_sql("h")} AS whole FROM a),
    c AS (SELECT *, {_header_sql("left(h, CAST(length(h) - (length(whole) - 100 + 1) AS INT)) || '…'")} AS short FROM b)
    SELECT doc_id, CASE WHEN length(whole) <= 100 THEN whole WHEN length(h) > length(whole) - 100 + 1 AND length(short) <= 100 THEN short ELSE '' END AS header FROM c"""
)
def fit_header(spark, sf_dir):
    profile = Profile(kind_labels=LABELS)

    def header(text: str, source: str) -> str:
        return C.header_for(profile, source, source, C.heading_of(text), 200)

    return table(spark, sf_dir, "documents").select("doc_id", _each(header, "string", F.col("text"), F.col("source")).alias("header"))


@register(f"SELECT page_id, sha256({_attribute_sql('html')}) AS attribute_sha256, sha256(replace(html, '<', '&lt;')) AS body_sha256 FROM pages")
def escape_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(T.escape_attribute(F.col("html")), 256).alias("attribute_sha256"), F.sha2(T.escape_body(F.col("html")), 256).alias("body_sha256"))


@register(f"SELECT doc_id, regexp_matches(text, '[А-Яа-яЁё]') AS is_cyrillic, CASE WHEN regexp_matches(text, '[А-Яа-яЁё]') THEN '{T.NO_BASIS['ru']}' ELSE '{T.NO_BASIS['en']}' END AS answer FROM documents")
def cyrillic_answer(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.has_cyrillic(F.col("text")).alias("is_cyrillic"), T.no_basis_answer(F.col("text")).alias("answer"))


@register(rf"SELECT doc_id, CAST(len(l) AS INT) AS n, sha256(array_to_string(l, '|')) AS sha FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?]){_WS}+', '\1' || chr(1), 'g'), chr(1)), lambda s: {_stripped('s')}), lambda s: s <> '') AS l FROM documents)")
def sentence_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", _each(C.sentences, "array<string>", F.col("text")).alias("l")).select("doc_id", F.size("l").alias("n"), F.sha2(F.array_join("l", "|"), 256).alias("sha"))


@register(rf"SELECT doc_id, CAST(len(l) AS INT) AS n, sha256(array_to_string(l, '|')) AS sha FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '(?m)^([A-E])', chr(1) || '\1', 'g'), chr(1)), lambda s: {_stripped('s')}), lambda s: s <> '') AS l FROM documents)")
def section_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", _each(lambda t: C.sections_of(t, SECTION), "array<string>", F.col("text")).alias("l")).select("doc_id", F.size("l").alias("n"), F.sha2(F.array_join("l", "|"), 256).alias("sha"))


@register(f"SELECT doc_id, CASE WHEN length(p) > {T.PREVIEW_CHARS} THEN left(p, {T.PREVIEW_CHARS}) || '...' ELSE p END AS preview FROM (SELECT doc_id, {_stripped('replace(text, chr(10), chr(32))')} AS p FROM documents)")
def preview_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.preview(F.col("text")).alias("preview"))


_HITS_SQL = " + ".join(f"CAST(contains(t, '{w}') AS INT)" for w in TOPIC_WORDS)


@register(f"SELECT doc_id, n, CASE WHEN n >= 2 THEN 'relevant' WHEN n >= 1 THEN 'doubtful' ELSE 'irrelevant' END AS label FROM (SELECT doc_id, {_HITS_SQL} AS n FROM (SELECT doc_id, {_squeezed('lower(text)')} AS t FROM documents))")
def keyword_classify(spark, sf_dir):
    text = T.squeeze(F.lower("text"))
    return table(spark, sf_dir, "documents").select("doc_id", T.keyword_hits(text, TOPIC_WORDS).alias("n"), V.relevance(F.col("text"), TOPIC_WORDS).alias("label"))


#: Topic rules of the kind of the report's, for the languages of the synthetic texts.
TOPICS = [
    {"any": ["der"], "keywords": ["der"], "sure": 1, "otherwise": "irrelevant"},
    {"any": ["the", "of"], "keywords": ["and", "with", "edth"], "otherwise": "doubtful"},
    {"all": ["de", "la"], "keywords": ["por", "les", "que"]},
]
OTHERWISE = {"keywords": ["que", "en"]}


def _sum_sql(x: str, words: list[str]) -> str:
    return "(" + " + ".join(f"CAST(contains({x}, '{w}') AS INT)" for w in words) + ")"


def _topic_sql(q: str, t: str) -> str:
    def graded(n: str) -> str:
        return f"CASE WHEN {n} >= 2 THEN 'relevant' WHEN {n} >= 1 THEN 'doubtful' ELSE 'irrelevant' END"

    first, second, third = (_sum_sql(t, r["keywords"]) for r in TOPICS)
    return f"""CASE WHEN contains({q}, 'der') THEN CASE WHEN {first} >= 1 THEN 'relevant' ELSE 'irrelevant' END
        WHEN contains({q}, 'the') OR contains({q}, 'of') THEN CASE WHEN {second} >= 2 THEN 'relevant' ELSE 'doubtful' END
        WHEN contains({q}, 'de') AND contains({q}, 'la') THEN {graded(third)} ELSE {graded(_sum_sql(t, OTHERWISE["keywords"]))} END"""


@register(f"SELECT doc_id, {_topic_sql('q', 't')} AS label FROM (SELECT doc_id, {_squeezed('lower(' + _heading_sql('text') + ')')} AS q, {_squeezed('lower(text)')} AS t FROM documents)")
def topic_classify(spark, sf_dir):
    """A document's heading as the question, its text as what was found."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", _each(C.heading_of, "string", F.col("text")).alias("q"))
    return docs.select("doc_id", V.classify(F.col("q"), F.col("text"), TOPICS, OTHERWISE).alias("label"))


def _found(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(questions, their raw hits) by the offline embedder."""
    asked = _questions(spark, sf_dir).withColumn("embedding", T.sha_embedding(F.col("query")))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id_num"), "text", "source", F.concat(F.lit("Source "), "source").alias("source_display"), F.col("lang").alias("section_heading"))
    return asked, D.hits(asked, docs.withColumn("embedding", T.sha_embedding(F.col("text"))), RAW)


_PREVIEW = f"CASE WHEN length(p) > {T.PREVIEW_CHARS} THEN left(p, {T.PREVIEW_CHARS}) || '...' ELSE p END"
_REPORTED = _CONTEXT + f", v AS (SELECT *, {_stripped('replace(text, chr(10), chr(32))')} AS p FROM r)"
_LABELLED = _REPORTED + f", t AS (SELECT *, {_squeezed('lower(query)')} AS lq, {_squeezed('lower(coalesce(lang, ' + chr(39) + '-' + chr(39) + ') || ' + chr(39) + ' ' + chr(39) + ' || ' + _PREVIEW + ')')} AS lt FROM v), l AS (SELECT *, {_topic_sql('lq', 'lt')} AS label FROM t)"


@register(_REPORTED + f"SELECT query_id, CAST(rank AS INT) AS rank, distance, 'Source ' || source AS source_display, source, lang AS section_heading, {_PREVIEW} AS preview FROM v")
def retrieval_report(spark, sf_dir):
    return D.retrieval_report(_found(spark, sf_dir)[1])


def _threshold(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return D.threshold_report(_found(spark, sf_dir)[1], lambda q, t: V.classify(q, t, TOPICS, OTHERWISE))


@register(_LABELLED + "SELECT query_id, CAST(rank AS INT) AS rank, distance, label FROM l")
def threshold_labels(spark, sf_dir):
    return _threshold(spark, sf_dir)[0].select("query_id", "rank", "distance", "label")


@register(_LABELLED + """, a AS (SELECT label, count(*) AS n, min(distance) AS low, max(distance) AS high FROM l GROUP BY label)
    SELECT b.label, coalesce(n, 0) AS n, coalesce(printf('%.6f..%.6f', low, high), 'n/a') AS distances FROM (VALUES ('relevant'), ('doubtful'), ('irrelevant')) b(label) LEFT JOIN a USING (label)""")
def threshold_ranges(spark, sf_dir):
    return _threshold(spark, sf_dir)[1]


@register(
    _CONTEXT + f""", n AS (SELECT query_id, count(*) AS raw FROM r GROUP BY query_id),
    g AS (SELECT query_id, count(*) AS final, list('Source ' || source || ' | ' || coalesce(lang, '(empty heading)') ORDER BY number) AS sources, string_agg(lower(text), ' ' ORDER BY number) AS t FROM s GROUP BY query_id)
    SELECT q.query_id, coalesce(raw, 0) AS raw, CAST(coalesce(final, 0) AS INT) AS final, array_to_string(coalesce(sources, []), ';') AS sources,
           coalesce(final, 0) > 0 AND NOT (contains(lower(query), 'the') AND NOT coalesce(contains(t, 'ingth') OR contains(t, 'thaf'), false)) AND NOT (contains(lower(query), 'que') AND NOT coalesce(contains(t, 'que'), false)) AS sufficient
    FROM q LEFT JOIN n USING (query_id) LEFT JOIN g USING (query_id)"""
)
def retrieval_simulation(spark, sf_dir):
    asked, found = _found(spark, sf_dir)
    out = D.simulation(asked, found, NEAR, FINAL, {"the": ["ingth", "thaf"], "que": ["que"]})
    return out.withColumn("sources", F.array_join("sources", ";"))


# -- chunks ----------------------------------------------------------------------------------------------------------


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("entry_ord"), "source", F.concat(F.lit("Source "), "source").alias("source_display"), F.coalesce("lang", F.lit("unknown")).alias("source_kind"), F.lit("overview").alias("doc_type"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_name"), "text")


_CUTS = [("chr(10) || chr(10)", 2), ("chr(10)", 1), *((f"'{c}'", len(c)) for c in C.CUTS[2:])]
_AT = [f"CASE WHEN contains(w, {c}) THEN length(w) - instr(reverse(w), reverse({c})) - {n - 1} ELSE -1 END" for c, n in _CUTS]


def _pieces_sql(name: str, bodies: str) -> str:
    """CTE `name` (k, body, lim, start, n, piece, done) of the hard pieces, n from 1, of the rows (k, body, lim) of `bodies`, with an overlap of 200 and limits of 400 or more."""
    return f"""{name}(k, body, lim, start, n, piece, done) AS (
        SELECT k, body, lim, CAST(0 AS BIGINT), 0, CAST(NULL AS VARCHAR), false FROM {bodies}
        UNION ALL
        SELECT k, body, lim, CASE WHEN length(body) - start <= lim THEN start ELSE start + cut - 200 END, n + 1,
               CASE WHEN length(body) - start <= lim THEN {_stripped("substr(body, CAST(start + 1 AS BIGINT))")} ELSE {_stripped("substr(w, 1, CAST(cut AS BIGINT))")} END, length(body) - start <= lim
        FROM (SELECT *, CASE {" ".join(f"WHEN {at} >= lim // 2 THEN {at} + {n}" for at, (_, n) in zip(_AT, _CUTS, strict=True))} ELSE lim END AS cut
              FROM (SELECT *, substr(body, CAST(start + 1 AS BIGINT), lim) AS w FROM {name} WHERE NOT done)))"""


def _carried_sql(x: str) -> str:
    """What a chunk carries over: its last 200 characters from the start of a sentence, found mark by mark."""
    begin = "CAST(0 AS BIGINT)"
    end = f"right({x}, 200)"
    for mark, n in (("'. '", 2), ("'! '", 2), ("'? '", 2), ("chr(10)", 1)):
        begin = f"(SELECT CASE WHEN instr({end}, {mark}) - 1 > b THEN instr({end}, {mark}) - 1 + {n} ELSE b END FROM (SELECT {begin} AS b))"
    return f"CASE WHEN length({x}) <= 200 THEN {x} ELSE {_stripped(f'substr({end}, CAST({begin} + 1 AS BIGINT))')} END"


def _segments_sql(x: str, language: str) -> str:
    """The sentences of a text by a language's rules: places that end none are marked with chr(57344), those that do with chr(57345), and the text is split there."""
    rules = S.RULES[language]
    words = "|".join(w.replace(".", "[.]") for w in sorted(rules.words, key=len, reverse=True))
    closing, opening = (f"[{re.escape(c)}]{{0,3}}".replace("'", "''") for c in (S.CLOSING, S.OPENING))
    head = r"(^|[^\p{L}\p{N}_.])"
    kept = [(rf"{head}({words})", "gi"), (rf"{head}(\p{{Lu}})", "g"), (r"(^|[\n\r])([ \t\x0B\f]{0,19}[0-9]{1,3})", "g"), *([(head + "([0-9]{1,2})", "g")] if rules.ordinals else [])]
    out = rf"regexp_replace({x}, '([.!?…]{closing})({_BLANK}+{opening}\p{{Ll}})', '\1' || chr(57344) || '\2', 'g')"
    for pattern, how in kept * 2:  # a match ends with the white space that the next one may begin with
        out = rf"regexp_replace({out}, '{pattern}[.]({_BLANK})', '\1\2.' || chr(57344) || '\3', '{how}')"
    cut = rf"string_split(regexp_replace({out}, '([.!?…]{closing}){_BLANK}+', '\1' || chr(57345), 'g'), chr(57345))"
    kept_text = f"regexp_replace(replace(s, chr(57344), ''), '^{_BLANK}+|{_BLANK}+$', '', 'g')"
    return f"list_filter(list_transform({cut}, lambda s: {kept_text}), lambda s: s <> '')"


def _chunks_sql(text: str) -> str:
    """The chunker over documents of one section: paragraphs are packed to 800, a long first one by sentences, then pieces are cut hard below the header."""
    full = "length(now) + length(unit) + {n} > 800 AND now <> ''"
    step = f"CASE WHEN full_ THEN {_carried_sql('now')} ELSE now END"
    return rf"""
    WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(lang, 'unknown') AS kind, {_stripped(text)} AS section FROM documents WHERE {_stripped(text)} <> ''),
    h AS (SELECT *, {_heading_sql("section")} AS heading FROM d),
    f AS (SELECT *, '[Source: Source ' || source || ' | ' || kind || ']' || chr(10) || '[Section: ' || heading || ']' || chr(10) || chr(10) AS head FROM h),
    q AS (SELECT doc_id, list_filter(list_transform(string_split(section, chr(10) || chr(10)), lambda s: {_stripped("s")}), lambda s: s <> '') AS paras FROM f WHERE length(section) > 800),
    u AS (SELECT doc_id, unnest(l) AS unit, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, {_segments_sql("paras[1]", "en")} AS l FROM q WHERE length(paras[1]) > 800)),
    g(doc_id, i, now, out) AS (
        SELECT doc_id, CAST(0 AS BIGINT), '', CAST(NULL AS VARCHAR) FROM q WHERE length(paras[1]) > 800
        UNION ALL
        SELECT doc_id, i + 1, CASE WHEN carry <> '' THEN carry || ' ' || unit ELSE unit END, CASE WHEN full_ THEN now END
        FROM (SELECT *, {step} AS carry FROM (SELECT g.doc_id, g.i, g.now, u.unit, {full.format(n=1)} AS full_ FROM g JOIN u ON u.doc_id = g.doc_id AND u.i = g.i + 1))),
    z AS (SELECT doc_id, i, now FROM g QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i DESC) = 1),
    y(doc_id, i, now, out) AS (
        SELECT doc_id, CASE WHEN z.now IS NULL THEN 0 ELSE 1 END, coalesce(z.now, ''), CAST(NULL AS VARCHAR) FROM q LEFT JOIN z USING (doc_id)
        UNION ALL
        SELECT doc_id, i + 1, CASE WHEN carry <> '' THEN carry || chr(10) || chr(10) || unit ELSE unit END, CASE WHEN full_ THEN now END
        FROM (SELECT *, {step} AS carry FROM (SELECT y.doc_id, y.i, y.now, q.paras[y.i + 1] AS unit, {full.format(n=2).replace("unit", "q.paras[y.i + 1]")} AS full_ FROM y JOIN q ON q.doc_id = y.doc_id AND y.i < len(q.paras)))),
    c AS (SELECT doc_id, 0 AS stage, i, out AS chunk FROM g WHERE out IS NOT NULL UNION ALL SELECT doc_id, 1, i, out FROM y WHERE out IS NOT NULL
          UNION ALL SELECT doc_id, 2, i, now FROM y QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i DESC) = 1),
    n AS (SELECT doc_id, {_stripped("chunk")} AS body, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY stage, i) - 1 AS INT) AS sub FROM c WHERE length(chunk) >= 80),
    b AS (SELECT doc_id, sub, body FROM n WHERE length(body) >= 80 UNION ALL SELECT doc_id, NULL, section FROM f WHERE length(section) <= 800),
    m AS (SELECT {{'doc_id': doc_id, 'sub': sub}} AS k, body, CAST(800 - length(head) AS BIGINT) AS lim FROM b JOIN f USING (doc_id)),
    {_pieces_sql("p", "m")},
    w AS (SELECT f.*, k.sub AS sub, n, head || piece AS whole FROM p JOIN f ON f.doc_id = p.k.doc_id WHERE n > 0 AND piece <> ''),
    chunks AS (SELECT doc_id AS entry_ord, row_number() OVER (PARTITION BY doc_id ORDER BY sub, n) - 1 AS chunk_ord, source, 'Source ' || source AS source_display, kind AS source_kind, 'overview' AS doc_type,
               doc_id || '.txt' AS file_name, heading AS section_heading, CAST(length(head) AS INT) AS header_len, sub AS subchunk_index, CAST(NULL AS INT) AS hard_split_index, CAST(length(whole) AS INT) AS unlimited_len, whole AS text
               FROM w WHERE length(whole) >= 80)
"""


_CHUNKS = _chunks_sql("text")


@register(_CHUNKS + "SELECT * FROM chunks")
def chunk_documents(spark, sf_dir):
    return C.chunk_documents(_sources(spark, sf_dir))


@register(_chunks_sql("replace(text, chr(10), chr(10) || chr(10))") + "SELECT * FROM chunks")
def chunk_paragraphs(spark, sf_dir):
    """The same with every line of a document as a paragraph of its own."""
    return C.chunk_documents(_sources(spark, sf_dir).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n"))))


@register(_CHUNKS + "SELECT 'doc_' || id_num AS id, id_num, entry_ord, chunk_ord FROM (SELECT row_number() OVER (ORDER BY entry_ord, chunk_ord) - 1 AS id_num, entry_ord, chunk_ord FROM chunks)")
def chunk_ids(spark, sf_dir):
    return C.with_ids(written(chunk_documents(spark, sf_dir).select("entry_ord", "chunk_ord"), "chunks")).select("id", "id_num", "entry_ord", "chunk_ord")


@register(_CHUNKS + "SELECT doc_id AS entry_ord, doc_id || '.txt' AS file_name, (SELECT count(*) FROM chunks WHERE entry_ord = doc_id) AS chunks FROM documents")
def chunk_counts(spark, sf_dir):
    return C.counts_by_file(_sources(spark, sf_dir), chunk_documents(spark, sf_dir))


@register(_CHUNKS + "SELECT count(*) AS before_total, coalesce(max(unlimited_len), 0) AS before_max_len, count(*) AS after_total, coalesce(max(length(text)), 0) AS after_max_len FROM chunks")
def chunk_summary(spark, sf_dir):
    return C.summary(chunk_documents(spark, sf_dir))


@register(f"""WITH RECURSIVE b AS (SELECT doc_id AS k, {_stripped("text")} AS body, CAST(800 AS BIGINT) AS lim FROM documents WHERE {_stripped("text")} <> ''), {_pieces_sql("p", "b")}
    SELECT k AS doc_id, CAST(n - 1 AS INT) AS part, sha256(piece) AS piece_sha256 FROM p WHERE n > 0""")
def hard_split(spark, sf_dir):
    pieces = _each(lambda t: C.hard_pieces(t, 800, 200), "array<string>", F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(pieces).alias("part", "piece")).select("doc_id", "part", F.sha2("piece", 256).alias("piece_sha256"))


@register(f"""WITH RECURSIVE r AS (SELECT doc_id, '[' || source || ']' || chr(10) || text AS t, CAST(length(source) + 3 AS INT) AS header_len FROM documents),
    b AS (SELECT doc_id AS k, {_stripped("t")} AS body, CAST(800 AS BIGINT) AS lim FROM r WHERE length(t) > 800), {_pieces_sql("p", "b")}
    SELECT doc_id, CAST(n - 1 AS INT) AS hard_split_index, CASE WHEN n > 1 THEN 0 ELSE header_len END AS header_len, sha256(piece) AS text_sha256 FROM p JOIN r ON doc_id = k WHERE n > 0 AND piece <> ''
    UNION ALL SELECT doc_id, NULL, header_len, sha256(t) FROM r WHERE length(t) <= 800""")
def hard_limit_pass(spark, sf_dir):
    """Documents below a header as chunks: those of more than 800 characters become numbered pieces, of which the first keeps the header."""
    head = F.concat(F.lit("["), "source", F.lit("]\n"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.length(head).alias("header_len"), F.concat(head, "text").alias("text"))
    return C.hard_limit(rows, 800, 200).select("doc_id", "hard_split_index", "header_len", F.sha2("text", 256).alias("text_sha256"))


_LANGUAGES = ("en", "de", "fr", "es")


@register("SELECT doc_id, CAST(len(l) AS INT) AS n, sha256(array_to_string(l, '|')) AS sha FROM (SELECT doc_id, CASE lang " + " ".join(f"WHEN '{x}' THEN {_segments_sql('text', x)}" for x in _LANGUAGES) + f" ELSE {_segments_sql('text', 'en')} END AS l FROM documents)")
def segment_sentences(spark, sf_dir):
    """Sentences by the rules of each document's language."""
    docs = table(spark, sf_dir, "documents")
    found = F.coalesce(*(F.when(F.col("lang") == x, S.sentence_array(F.col("text"), x)) for x in _LANGUAGES), S.sentence_array(F.col("text"), "en"))
    return docs.select("doc_id", found.alias("l")).select("doc_id", F.size("l").alias("n"), F.sha2(F.array_join("l", "|"), 256).alias("sha"))


# -- evaluation and lifecycle ----------------------------------------------------------------------------------------

_METRICS = "WITH m AS (SELECT 'quality' AS metric, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE CAST(quality AS DOUBLE) END AS value FROM labels UNION ALL SELECT 'clean', CAST(1 - toxic AS DOUBLE) FROM labels), a AS (SELECT metric, avg(value) AS mean, count(value) AS n_valid FROM m GROUP BY metric)"


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh quality is NaN: not computed."""
    labels = table(spark, sf_dir, "labels")
    quality = labels.select(F.lit("quality").alias("metric"), F.when(F.col("doc_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("quality").cast("double")).alias("value"))
    return quality.unionByName(labels.select(F.lit("clean").alias("metric"), (1 - F.col("toxic")).cast("double").alias("value")))


@register(_METRICS + "SELECT metric, mean, n_valid FROM a")
def metric_means(spark, sf_dir):
    return V.metric_means(_metrics(spark, sf_dir))


@register(_METRICS + "SELECT coalesce(avg(mean), 0.0) AS overall, CASE WHEN coalesce(avg(mean), 0.0) >= 0.7 THEN 'good' WHEN coalesce(avg(mean), 0.0) >= 0.5 THEN 'fair' ELSE 'poor' END AS verdict FROM a")
def overall_verdict(spark, sf_dir):
    return V.overall(V.metric_means(_metrics(spark, sf_dir)))


@register(
    """WITH e AS (SELECT CAST(c_nationkey AS VARCHAR) AS name, CAST(count(*) AS VARCHAR) AS now FROM customer GROUP BY 1), s AS (SELECT CAST(s_nationkey AS VARCHAR) AS name, CAST(count(*) AS VARCHAR) AS was FROM supplier GROUP BY 1)
    SELECT name, was, now FROM e FULL JOIN s USING (name) WHERE was IS DISTINCT FROM now"""
)
def manifest_diff(spark, sf_dir):
    """Fields and values of two real tables: customers and suppliers of each nation."""

    def counts(name: str, key: str) -> DataFrame:
        return table(spark, sf_dir, name).groupBy(F.col(key).cast("string").alias("name")).agg(F.count("*").cast("string").alias("value"))

    return problems_table(counts("customer", "c_nationkey"), counts("supplier", "s_nationkey"))


_VALUES = """
    p AS (SELECT *, row_number() OVER o AS rank, sum(CAST(yes AS INT)) OVER o AS so_far FROM v WHERE yes IS NOT NULL WINDOW o AS (PARTITION BY query_id, metric ORDER BY item)),
    s AS (SELECT query_id, metric, count(*) AS n, sum(CAST(yes AS INT)) AS good, sum(CAST(yes AS INT) * so_far / rank) AS gain FROM p GROUP BY query_id, metric),
    e AS (SELECT query_id, unnest(['faithfulness', 'context_precision', 'context_utilization']) AS metric FROM cases)
    SELECT query_id, metric, CASE WHEN metric = 'faithfulness' THEN good / n WHEN good > 0 THEN gain / good WHEN n > 0 THEN 0.0 END AS value FROM e LEFT JOIN s USING (query_id, metric)
"""


@register(
    """WITH v AS (SELECT doc_id % 50 AS query_id, 'faithfulness' AS metric, doc_id AS item, CASE WHEN doc_id % 7 > 0 THEN toxic = 0 END AS yes FROM labels
               UNION ALL SELECT doc_id % 50, 'context_precision', doc_id, quality = 1 FROM labels UNION ALL SELECT item_id % 50, 'context_utilization', item_id, length(text) % 2 = 0 FROM benchmark),
    cases AS (SELECT DISTINCT doc_id % 50 AS query_id FROM labels),""" + _VALUES
)
def verdict_metrics(spark, sf_dir):
    """Labels and benchmark items as verdicts of a judge; some labels were not decided, and some queries have no items of a metric."""
    labels, benchmark = table(spark, sf_dir, "labels"), table(spark, sf_dir, "benchmark")

    def verdicts(rows: DataFrame, key: str, metric: str, yes) -> DataFrame:
        return rows.select((F.col(key) % 50).alias("query_id"), F.lit(metric).alias("metric"), F.col(key).alias("item"), yes.alias("verdict"))

    given = verdicts(labels, "doc_id", J.FAITHFULNESS, F.when(F.col("doc_id") % 7 > 0, F.col("toxic") == 0))
    given = given.unionByName(verdicts(labels, "doc_id", J.PRECISION, F.col("quality") == 1)).unionByName(verdicts(benchmark, "item_id", J.UTILIZATION, F.length("text") % 2 == 0))
    return J.metrics(given, labels.select((F.col("doc_id") % 50).alias("query_id")))


def _word_set_sql(x: str) -> str:
    return rf"list_distinct(list_filter(regexp_split_to_array(lower({x}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> ''))"


@register(
    f"""WITH cases AS (SELECT u.conv_id * 1000 + u.turn AS query_id, u.text AS question, a.text AS answer, (SELECT list(c.text ORDER BY c.turn) FROM conversations c WHERE c.conv_id = u.conv_id AND c.role = 'user' AND c.turn <= u.turn) AS contexts
                   FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role <> 'user'),
    j AS (SELECT query_id, 'faithfulness' AS metric, unnest(l) AS statement, generate_subscripts(l, 1) AS item, array_to_string(contexts, chr(10) || chr(10)) AS evidence FROM (SELECT *, {_segments_sql("answer", "en")} AS l FROM cases)
          UNION ALL SELECT query_id, 'context_precision', question, generate_subscripts(contexts, 1), unnest(contexts) FROM cases
          UNION ALL SELECT query_id, 'context_utilization', answer, generate_subscripts(contexts, 1), unnest(contexts) FROM cases),
    v AS (SELECT query_id, metric, item, CASE WHEN len({_word_set_sql("statement")}) > 0 THEN 100 * len(list_intersect({_word_set_sql("statement")}, {_word_set_sql("evidence")})) >= 25 * len({_word_set_sql("statement")}) END AS yes FROM j),""" + _VALUES
)
def judged_metrics(spark, sf_dir):
    """Conversations as cases: replies are answers, all earlier user turns the context, the question its own reference; judged offline by shared words."""
    turns = table(spark, sf_dir, "conversations")
    number = F.col("conv_id") * 1000 + F.col("turn")
    users = turns.where("role = 'user'").select("conv_id", "turn", number.alias("query_id"), F.col("text").alias("question"))
    replies = turns.where("role <> 'user'").select((number - 1).alias("query_id"), F.col("text").alias("answer"))
    heard = turns.where("role = 'user'").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("heard"))  # the turns of one conversation
    cases = users.join(replies, "query_id").join(heard, "conv_id").withColumn("contexts", F.expr("transform(filter(heard, x -> x.turn <= turn), x -> x.text)")).withColumn("ground_truth", F.col("question"))
    cases = written(cases.select("query_id", "question", "answer", "contexts", "ground_truth"), "cases")
    given = J.requests(cases).withColumn("verdict", J.overlap_verdict(F.col("statement"), F.col("evidence"), 25))
    return J.metrics(given, cases)


@register(
    """WITH u AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'), a AS (SELECT conv_id, turn, text FROM conversations WHERE role <> 'user')
    SELECT u.conv_id * 1000 + u.turn AS query_id, u.text AS question, a.text AS answer, array_to_string([u.text, a.text], '|') AS contexts, 'truth of ' || u.text AS ground_truth FROM u JOIN a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1"""
)
def evaluation_frame(spark, sf_dir):
    """User turns as cases, the next turn as the answer, both as its context."""
    turns = table(spark, sf_dir, "conversations")
    number = F.col("conv_id") * 1000 + F.col("turn")
    cases = turns.where("role = 'user'").select(number.alias("query_id"), F.col("text").alias("question"), F.concat(F.lit("truth of "), "text").alias("ground_truth"))
    replies = turns.where("role <> 'user'").select((number - 1).alias("query_id"), F.col("text").alias("answer"))
    answers = replies.join(cases.select("query_id", F.col("question").alias("q")), "query_id").select("query_id", "answer", F.array(F.struct(F.col("q").alias("text")), F.struct(F.col("answer").alias("text"))).alias("context"))
    return V.evaluation_frame(cases, answers).withColumn("contexts", F.array_join("contexts", "|"))


@register(r"SELECT page_id, regexp_extract(lower(url), '^[a-z]+://') || regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)), '^[^@]*@', '') || regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') AS endpoint FROM pages")
def endpoint_normalize(spark, sf_dir):
    @F.pandas_udf("string")
    def normal(urls: pd.Series) -> pd.Series:
        return urls.map(I.normal_endpoint)

    return table(spark, sf_dir, "pages").select("page_id", normal("url").alias("endpoint"))


FLAGSHIP = QUERIES["vector_selection"]
