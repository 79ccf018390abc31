"""Thin queries over the synthetic tables: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import anchors, bpe, decontam, langid, lattice, linededup, lzprint, mixing, ngram_join, periodic, recordio, toxicity, warc
from lodestone.llm.shared import documents
from lodestone.runtime import query

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def fold(n: int) -> Column:
    """crc32 of doc_id as text modulo n; a null doc_id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(n))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    found = langid.predict(docs.select("doc_id", "text"), docs.where(fold(3) != 1))
    return found.select("doc_id", (fold(3) == 1).alias("held_out"), "lang_pred", "score")


def op2_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recordio.digests(spark, recordio.write(documents(spark, sf_dir), tokenizer_path()))


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir), tokenizer_path())


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = toxicity.train(docs.where(fold(5) != 0), documents(spark, sf_dir, "labels").where(fold(5) != 0))
    found = toxicity.score(docs, model)
    return found.select("doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, removed (the numbers of the lines that go, ascending, joined by commas; empty if none) and the sha256 of the text that is left."""
    found = linededup.dedup(documents(spark, sf_dir).select("doc_id", "text"), removed="removed")
    numbers = F.transform(F.sort_array(F.coalesce("removed", F.array().cast("array<int>"))), lambda x: x.cast("string"))
    return found.select("doc_id", F.array_join(numbers, ",").alias("removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op6_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.score(documents(spark, sf_dir), fold(10) != 0)
    return found.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op7_warc_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.capture_histories(spark, documents(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(documents(spark, sf_dir))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.digests(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op10_phrase_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lzprint.digests(documents(spark, sf_dir))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anchors.digests(documents(spark, sf_dir))


def op12_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.interactions(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(periodic.with_planted_runs(documents(spark, sf_dir)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: query(f) for f in (op1_language_id, op2_token_records, op3_bpe_round_trip, op4_toxicity, op5_line_dedup, op6_context_mixing, op7_warc_index_merge, op8_ngram_jaccard_join, op9_benchmark_decontamination, op10_phrase_fingerprint, op11_substring_dedup, op12_filter_interactions, op13_periodic_runs)}

#: Base32 of a SHA-1 from its 40 hex digits: each 5 of them are 4 letters.
_BASE32 = "array_to_string(flatten(list_transform(range(0, 8), lambda i: list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, CAST(5 * i + 1 AS INT), 5))::INT >> s) & 31) + 1, 1)))), '')"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str) -> str:
    return rf"regexp_extract_all(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


#: Words of a line, as the line dedup cuts them.
_LINE_WORDS = r"list_filter(list_distinct(regexp_split_to_array(lower(line), '[ \t\n\x0B\f\r!-/:-@\[-`{-~]+')), lambda x: x <> '')"

SQL: dict[str, str] = {
    "op5_line_dedup": f"""
        WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS no FROM documents),
        w AS (SELECT doc_id, no, line, list_sort({_LINE_WORDS}) AS w FROM l),
        s AS (SELECT w, len(w) AS n, min((doc_id, no)) AS fst, row_number() OVER () AS id FROM w WHERE len(w) > 0 GROUP BY w),
        t AS (SELECT id, n, fst, unnest(w) AS x FROM s),
        f AS (SELECT x, count(*) AS c FROM t GROUP BY x),
        p AS (SELECT id, n, fst, x FROM t JOIN f USING (x) WHERE n >= 4 QUALIFY row_number() OVER (PARTITION BY id ORDER BY c, x) <= n - ceil(n * 0.8 - 1e-9) + 1),
        c AS (SELECT DISTINCT a.id AS x, b.id AS y FROM p a JOIN p b ON a.x = b.x AND a.fst < b.fst AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
        g AS (SELECT DISTINCT y FROM c JOIN s a ON a.id = x JOIN s b ON b.id = y WHERE 9 * len(list_intersect(a.w, b.w)) >= 4 * (a.n + b.n)),
        r AS (SELECT w.*, s.id IS NOT NULL AND (s.fst <> (doc_id, no) OR g.y IS NOT NULL) AS gone FROM w LEFT JOIN s ON s.w = w.w LEFT JOIN g ON g.y = s.id),
        o AS (SELECT doc_id, string_agg(no::VARCHAR, ',' ORDER BY no) FILTER (gone) AS removed, string_agg(line, chr(10) ORDER BY no) FILTER (NOT gone) AS text FROM r GROUP BY doc_id)
        SELECT doc_id, coalesce(removed, '') AS removed, sha256(coalesce(o.text, '')) AS text_sha256 FROM documents LEFT JOIN o USING (doc_id)
    """,
    "op8_ngram_jaccard_join": f"""
        WITH RECURSIVE w AS (SELECT doc_id, {_words("text")} AS w FROM documents),
        g AS (SELECT doc_id, w, unnest(CASE WHEN len(w) >= 5 THEN range(1, len(w) - 3) WHEN len(w) > 0 THEN [1] ELSE [] END) AS p FROM w),
        s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, p, p + 4), ' ') AS s FROM g),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
        l AS (SELECT x, y, k = a.n AND k = b.n AS same FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 9 * k >= 4 * (a.n + b.n)),
        r(x, y) AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
        c AS (SELECT x, min(y) AS y FROM r GROUP BY x),
        t AS (SELECT x, count(*) AS links, count(*) FILTER (same) AS copies, min(y) FILTER (same) AS copy FROM l GROUP BY x)
        SELECT doc_id, least(doc_id, coalesce(c.y, doc_id)) AS class_id, least(doc_id, coalesce(copy, doc_id)) AS copy_id, 1 + coalesce(copies, 0) AS n_copies, coalesce(links, 0) AS n_links
        FROM documents LEFT JOIN c ON c.x = doc_id LEFT JOIN t ON t.x = doc_id
    """,
    "op9_benchmark_decontamination": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_words("text")} AS w FROM documents),
        i AS (SELECT item_id, {_words("text")} AS w FROM benchmark),
        a AS (SELECT item_id, w, least(len(w), 13) AS k, unnest(range(1, greatest(len(w) - 11, 2))) AS p FROM i WHERE len(w) > 0),
        iw AS (SELECT DISTINCT item_id, k, array_to_string(list_slice(w, p, p + k - 1), ' ') AS s FROM a),
        b AS (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM iw) WHERE len(w) >= k),
        dw AS (SELECT r, k, p, array_to_string(list_slice(w, p, p + k - 1), ' ') AS s FROM b),
        m AS (SELECT r, p, iw.k, item_id FROM dw JOIN iw ON dw.k = iw.k AND dw.s = iw.s),
        h AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(range(p, p + k)) AS q FROM m) GROUP BY r),
        f AS (SELECT r, count(*) AS n, string_agg(x, ',' ORDER BY x) AS x FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM m WHERE item_id IS NOT NULL) GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(f.n, 0) AS n_items, sha256(coalesce(x, '')) AS items_sha256,
               coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN h USING (r) LEFT JOIN f USING (r)
    """,
    "op11_substring_dedup": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        p AS (SELECT r, doc_id, p, array_to_string(list_slice(w, p, p + 12), ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - 11)) AS p FROM d)),
        f AS (SELECT s, min(doc_id) AS fst FROM p GROUP BY s HAVING min(doc_id) < max(doc_id)),
        c AS (SELECT DISTINCT r, unnest(range(p, p + 13)) AS q FROM p JOIN f USING (s) WHERE fst < doc_id),
        g AS (SELECT r, list(q) AS q FROM c GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(len(q), 0) AS n_removed,
               sha256(array_to_string(CASE WHEN q IS NULL THEN w ELSE list_where(w, list_transform(range(1, len(w) + 1), lambda i: NOT list_contains(q, i))) END, ' ')) AS kept_sha256
        FROM d LEFT JOIN g USING (r)
    """,
    "op12_filter_interactions": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part FROM documents),
        w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS fst FROM d),
        l AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id),
        m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
                     [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 10 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > fst, false)] AS bad
              FROM w LEFT JOIN l USING (doc_id)),
        f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
        o AS (SELECT a.f || b.f || c.f || d.f || e.f AS o FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
        s AS (SELECT o, step, ascii(substr(o, step, 1)) - 64 AS x, list_transform(range(1, step), lambda i: ascii(substr(o, i, 1)) - 64) AS done FROM o, (SELECT CAST(unnest(range(1, 6)) AS INT) AS step)),
        g AS (SELECT part, bad, good, toxic, count(*) AS n FROM m GROUP BY ALL),
        c AS (SELECT part, o, step, x, n, good, toxic, bad[x] AS fails, len(list_filter(done, lambda i: bad[i])) > 0 AS gone, len(list_filter(bad, lambda b: b)) = 1 AS once FROM g, s),
        r AS (SELECT part, o, step, x, sum(n) FILTER (NOT gone AND NOT fails) AS kept, sum(n) FILTER (NOT gone AND fails) AS removed, sum(n) FILTER (gone AND fails) AS redundant,
                     sum(n) FILTER (fails AND once) AS unique_fails, sum(n) FILTER (NOT gone AND fails AND good) AS good_lost, sum(n) FILTER (NOT gone AND fails AND toxic) AS toxic_lost
              FROM c GROUP BY part, o, step, x)
        SELECT part, o AS filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
               CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
               CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
        FROM r
    """,
    "op7_warc_index_merge": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS body, url, sha1(coalesce(html, '')) AS h FROM pages),
        m AS (SELECT h, max(page_id) AS best FROM p GROUP BY h)
        SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
               CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> best THEN best END AS refers_to
        FROM p JOIN m USING (h)
    """,
}
