"""The registered queries of the numbered operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from stallwise.llm.covertree import vector_links
from stallwise.llm.debruijn import dedup_substrings
from stallwise.llm.decontaminate import with_leaks
from stallwise.llm.divergence import audit
from stallwise.llm.extraction import extract_text
from stallwise.llm.language import identify, learn
from stallwise.llm.licences import learn as learn_licences, with_licences
from stallwise.llm.oddsketch import dedup_report
from stallwise.llm.packing import pack
from stallwise.llm.periods import with_runs
from stallwise.llm.suffixes import dedup_passages
from stallwise.llm.toxicity import THRESHOLD, learn as learn_toxicity, with_severity
from stallwise.llm.voronoi import top_products

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


@query()
def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in sequences of 2048 tokens, each a mix of the sources in corpus proportions."""
    pieces = pack(table(spark, folder, "documents"), length=2048)
    crc = F.crc32("ids").alias("ids_crc32")
    return pieces.select("doc_id", "start", "length", crc, "doc_tokens", "sequence_id", "offset")


@query()
def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Every document and the benchmark items that it holds; kept if there are none."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = with_leaks(docs, table(spark, folder, "benchmark"))
    items = F.array_sort(F.array_distinct("leaks.item_id")).alias("item_ids")
    edits = F.array_max("leaks.edits").alias("most_edits")
    return found.select("doc_id", (F.size("leaks") == 0).alias("kept"), F.size("leaks").alias("n_leaks"), items, edits)


@query(
    sql="""
    WITH RECURSIVE v AS (
      SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
      WHERE label IS NOT NULL AND list_count(embedding) = len(embedding)
        AND list_bool_and(list_transform(embedding, lambda x: isfinite(x)))
        AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
    l AS (
      SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
    r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
    c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
    n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
    SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
    FROM c LEFT JOIN n USING (vec_id)"""
)
def op3_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Links of all vectors with equal labels at a cosine of 0.93 or more, and their components."""
    return vector_links(table(spark, folder, "embeddings"), cosine=0.93)


@query(
    sql=r"""
    WITH RECURSIVE w AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS words FROM documents),
    s AS (
      SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 3
        THEN list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])
        WHEN len(words) > 0 THEN [array_to_string(words, ' ')] END) AS shingle FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
    p AS (
      SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    l AS (
      SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
    r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
    c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
    SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)"""
)
def op4_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Documents by components of Jaccard similarity 0.85 or more on three-word shingles."""
    return dedup_report(table(spark, folder, "documents"), k=3, percent=85)


@query()
def op5_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Documents without the passages of 50 words or more that stand earlier elsewhere."""
    done = dedup_passages(table(spark, folder, "documents").select("doc_id", "text"), length=50)
    kept = (F.col("n_removed") == 0).alias("kept")
    return done.select("doc_id", kept, "n_words", "n_removed", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


@query()
def op6_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """The main text of every page."""
    return extract_text(table(spark, folder, "pages").select("page_id", "url", "html"))


@query(
    sql=r"""
    WITH w AS (
      SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
    v AS (
      SELECT doc_id, i, array_to_string(words[i : i + 19], ' ') AS win FROM w, (SELECT unnest(range(1, (SELECT max(len(words)) FROM w) - 18)) AS i)
      WHERE i <= len(words) - 19),
    g AS (
      SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS k FROM v) WHERE k > 1),
    gone AS (SELECT DISTINCT doc_id, i + o AS i FROM g, (SELECT unnest(range(0, 20)) AS o)),
    t AS (SELECT doc_id, i, words[i] AS word FROM w, (SELECT unnest(range(1, (SELECT max(len(words)) FROM w) + 1)) AS i) WHERE i <= len(words)),
    k AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept FROM t ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
    SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM w LEFT JOIN k USING (doc_id)"""
)
def op7_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Documents without the words of 20-word windows that start earlier elsewhere."""
    done = dedup_substrings(table(spark, folder, "documents").select("doc_id", "text"), length=20)
    return done.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query()
def op8_licence_scan(spark: SparkSession, folder: str) -> DataFrame:
    """The licence notices of every document."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = with_licences(docs, learn_licences(docs))
    families = F.array_sort(F.array_distinct("licences.family")).alias("families")
    versions = F.array_sort(F.array_distinct(F.filter("licences.version", lambda v: v.isNotNull()))).alias("versions")
    return found.select("doc_id", F.size("licences").alias("n_notices"), families, versions, F.round(F.array_max("licences.p"), 4).alias("best_p"))


@query()
def op9_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document, learnt from those whose crc32(doc_id) mod 4 is not 2."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    net = learn(docs, ~held_out & F.col("doc_id").isNotNull())
    told = identify(docs, net)
    return told.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query()
def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's chance to be toxic and expected severity from 0 to 3."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    told = with_severity(docs, learn_toxicity(docs, table(spark, folder, "labels")))
    toxic = F.col("p_toxic") >= THRESHOLD
    return told.select("doc_id", toxic.alias("toxic"), (~toxic).alias("kept"), F.round("p_toxic", 6).alias("p_toxic"), F.round("severity", 6).alias("severity"))


@query(
    sql=r"""
    WITH RECURSIVE b AS (
      SELECT doc_id, CAST(doc_id AS VARCHAR) AS s, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    crc(doc_id, s, k, x) AS (
      SELECT doc_id, s, 0, 4294967295::BIGINT FROM b
      UNION ALL
      SELECT doc_id, s, k + 1, CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384::BIGINT) ELSE y >> 1 END
      FROM (SELECT *, CASE WHEN k % 8 = 0 THEN xor(x, ascii(s[k // 8 + 1])::BIGINT) ELSE x END AS y FROM crc WHERE k < 8 * len(s))),
    h AS (SELECT doc_id, xor(x, 4294967295::BIGINT) AS h FROM crc WHERE k = 8 * len(s)),
    a AS (SELECT doc_id, len(w) AS n, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM b JOIN h USING (doc_id)),
    o AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM b),
    m AS (
      SELECT doc_id, n, i, CASE WHEN a IS NULL OR i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END AS j
      FROM a JOIN o USING (doc_id)),
    t AS (SELECT m.doc_id, n, m.i, word FROM m JOIN o ON m.doc_id = o.doc_id AND m.j = o.i),
    p AS (
      SELECT x.doc_id, y.i - x.i AS q, x.i FROM t x JOIN t y
      ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
    l AS (
      SELECT doc_id, q, min(i) AS start, count(*) + q AS length
      FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM p)
      GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
    r AS (SELECT doc_id, start, length, min(q) AS period FROM l GROUP BY doc_id, start, length),
    best AS (
      SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length::DOUBLE / period DESC, start, period) = 1),
    told AS (
      SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines
      FROM r GROUP BY doc_id),
    gone AS (SELECT DISTINCT t.doc_id, t.i FROM t JOIN r ON t.doc_id = r.doc_id AND t.i >= r.start + r.period AND t.i < r.start + r.length),
    left_ AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM t ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
    SELECT b.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period,
      (1000 * length // period)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
    FROM b LEFT JOIN told USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN left_ USING (doc_id)"""
)
def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of words that repeat four times or more in a row, one document in ten said over again first."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    told = with_runs(docs, least=6, repeats=4, double_by="doc_id", digests=True)
    return told.drop("text")


@query(
    sql=r"""
    WITH d AS (
      SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
    t AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
    c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM t GROUP BY ALL),
    k AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term HAVING sum(docs) >= 3),
    v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
    g AS (SELECT DISTINCT lang, source FROM d),
    own AS (SELECT lang, source, sum(n) AS n FROM c SEMI JOIN k USING (lang, term) GROUP BY lang, source),
    p AS (
      SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
        1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (coalesce(own.n, 0) + v.v) AS p,
        1 + (1000000000::HUGEINT * (k.n + 1)) // (v.n + v.v) AS q
      FROM g JOIN v ON g.lang = v.lang JOIN k ON g.lang = k.lang LEFT JOIN own ON own.lang = g.lang AND own.source = g.source
        LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
    s AS (
      SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    e AS (
      SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
      UNION ALL
      SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q)
    SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM e)
    WHERE part = 'pair' OR rank <= 200"""
)
def op12_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    """How far the sources of each language lie apart, and the terms that set each one apart."""
    return audit(table(spark, folder, "documents").select("lang", "source", "text"), terms=200, least=3)


@query(
    sql="""
    WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
      WHERE list_count(embedding) = len(embedding) AND list_bool_and(list_transform(embedding, lambda x: isfinite(x)))),
    s AS (
      SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e))
    SELECT query_id, rank::INT AS rank, vec_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""
)
def op13_topk_search(spark: SparkSession, folder: str) -> DataFrame:
    """The five rows of highest inner product with each vector whose id is divisible by 50."""
    return top_products(table(spark, folder, "embeddings"), k=5, every=50, scale=256.0)
