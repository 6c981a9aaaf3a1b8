"""The registered queries of the training-data operators on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure, scratch, settle
from . import bytebpe, centroids, decontaminate, langid, lexical, minhash, neighbours, packing, ppm, quality, secretscan, substrings, tokenfiles
from .common import fold, read

SIZE = 4096


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.digests(read(configure(spark), folder, "documents"), tokenizer_path(), SIZE)


def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(configure(spark), folder, "documents")
    model = langid.fit(langid.sample(docs.filter(fold(F.col("doc_id"), 5) != 0)))
    return langid.identify(docs, model).select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")


def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    # id 124 stands for the byte C0, which no UTF-8 text holds
    path = scratch(configure(spark), "token-files")
    tokenfiles.write(read(spark, folder, "documents"), path, tokenizer_path(), 124)
    return tokenfiles.scan(spark, path, 124).select(F.regexp_extract("file", "([^/]+)$", 1).alias("file"), "document", "start", F.col("length").alias("n_tokens"))


def op4_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    vectors = read(configure(spark), folder, "embeddings")
    return neighbours.nearest(vectors, vectors.filter("vec_id % 100 = 0"))


def op5_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(configure(spark), folder, "documents")
    found = secretscan.scan(docs, secretscan.fit(secretscan.findings(docs)))
    return found.select("doc_id", "start", "length", F.sha2(F.col("value").cast("binary"), 256).alias("value_sha256"), "score", "secret")


def op6_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = read(configure(spark), folder, "documents"), read(spark, folder, "labels")
    learn = labels.filter(fold(F.col("doc_id"), 3) != 1)
    docs = settle(quality.measured(docs, "doc_id"), "measures")
    model = quality.fit(quality.sample(docs, learn), quality.shares(learn))
    return quality.rate(docs, model).select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")


def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contaminated(read(configure(spark), folder, "documents"), read(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op8_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    left = substrings.remove(read(configure(spark), folder, "documents"))
    removed = F.aggregate("repeats", F.lit(0).cast("long"), lambda a, r: a + r["last"] - r["first"])
    return left.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op9_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(read(configure(spark), folder, "documents"))


def op10_ppm_scores(spark: SparkSession, folder: str) -> DataFrame:
    return ppm.score(read(configure(spark), folder, "documents"))


def op11_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    codec = bytebpe.Codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    found = bytebpe.encode(read(configure(spark), folder, "documents"), codec, public_tokenizers.PATTERN, decoded=True)
    return found.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2("bytes", 256).alias("decoded_sha256"))


def op12_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.search(read(configure(spark), folder, "documents"), read(spark, folder, "benchmark"))


def op13_centroid_clusters(spark: SparkSession, folder: str) -> DataFrame:
    found, final, _ = centroids.cluster(read(configure(spark), folder, "embeddings"))
    return centroids.described(found, final)


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_language_id, op3_token_counts, op4_nearest_neighbours, op5_secret_scan, op6_quality_classifier, op7_decontamination, op8_substring_dedup, op9_near_duplicates, op10_ppm_scores, op11_byte_bpe, op12_ranked_search, op13_centroid_clusters)}
BIG, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS_7 = f"regexp_extract_all(translate(coalesce(text, ''), '{BIG}', '{SMALL}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"

WORDS_12 = f"regexp_extract_all(translate(coalesce(text, ''), '{BIG}', '{SMALL}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"


def rounds_sql(k: int = 8, rounds: int = 10) -> str:
    """The clustering round by round: ``a`` assigns, ``c`` holds the centroids."""
    parts = [f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
        c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), x) - 1 AS j, x AS y FROM v ORDER BY j LIMIT {k})"""]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (SELECT r, min(struct_pack(d := d, j := j)) AS n FROM (
            SELECT r, j, list_sum(list_transform(range(1, 65), lambda i: (x[i] - y[i]) * (x[i] - y[i]))) AS d FROM v, c{i}) GROUP BY r)""")
        if i < rounds:
            parts.append(f"""s{i} AS (SELECT n.j AS j, p, sum(x[p]) AS s, count(*) AS m FROM v JOIN a{i} USING (r), unnest(range(1, 65)) AS t(p) GROUP BY ALL),
            m{i} AS (SELECT j, list(CAST((s - ((s % m) + m) % m) // m AS BIGINT) ORDER BY p) AS y FROM s{i} GROUP BY j),
            c{i + 1} AS MATERIALIZED (SELECT j, coalesce(m.y, c.y) AS y FROM c{i} c LEFT JOIN m{i} m USING (j))""")
    return f"""WITH {", ".join(parts)}
        SELECT vec_id, CAST(n.j AS INTEGER) AS cluster, CAST(n.d AS BIGINT) AS distance, CAST(sum(n.d) OVER (PARTITION BY n.j) AS BIGINT) AS cluster_inertia,
            CAST(sum(n.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(y, ',')) AS centroid_sha256
        FROM v JOIN a{rounds} USING (r) JOIN c{rounds} ON j = n.j"""


ORACLE: dict[str, str] = {
    "op12_ranked_search": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS_12} AS w FROM documents),
        s AS (SELECT count(*) FILTER (len(w) > 0) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d),
        q AS (SELECT DISTINCT item_id, unnest({WORDS_12}) AS t FROM benchmark),
        p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
        f AS (SELECT t, CAST(floor(1000 * ln((2 * n + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM p, s GROUP BY t, n),
        x AS (SELECT item_id, r, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(w) * n) // l)))) AS BIGINT) AS score
            FROM q JOIN p USING (t) JOIN f USING (t) JOIN d USING (r), s GROUP BY ALL),
        o AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST, r) AS rank FROM x JOIN d USING (r) WHERE score > 0)
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM o WHERE rank <= 10""",
    "op13_centroid_clusters": rounds_sql(),
    "op7_decontamination": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS_7} AS w FROM documents),
        b AS (SELECT item_id, {WORDS_7} AS w FROM benchmark WHERE item_id IS NOT NULL),
        bw AS (SELECT DISTINCT item_id, w[i:i + 9] AS win FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
        sizes AS (SELECT DISTINCT len(win) AS l FROM bw),
        dw AS (SELECT r, i, l, w[i:i + l - 1] AS win FROM d, sizes, unnest(range(1, len(w) - l + 2)) AS t(i)),
        m AS (SELECT r, i, l, item_id FROM dw JOIN bw USING (win)),
        hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM m, unnest(range(i, i + l)) AS q(p) GROUP BY r),
        it AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
            coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r)""",
    "op8_substring_dedup": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
        win AS (SELECT r, doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM d, unnest(range(1, len(w) - 48)) AS t(i)),
        f AS (SELECT h, min(doc_id) AS least FROM win GROUP BY h),
        gone AS (SELECT DISTINCT r, p FROM win JOIN f USING (h), unnest(range(i, i + 50)) AS q(p) WHERE doc_id > least),
        each AS (SELECT r, p, w[p] AS word FROM d, unnest(range(1, len(w) + 1)) AS t(p)),
        kept AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS words FROM each ANTI JOIN gone USING (r, p) GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(words, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (r)""",
    "op9_near_duplicates": f"""
        WITH RECURSIVE d AS (SELECT doc_id, {WORDS.format(f"translate(coalesce(text, ''), '{BIG}', '{SMALL}')")} AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS h FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(i) WHERE len(w) > 0),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
        link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
        edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
        reach AS (SELECT a AS x, b AS y FROM edge UNION SELECT x, b FROM reach JOIN edge ON y = a),
        least AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
        SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(y, d.doc_id)) AS component_id, d.doc_id <= coalesce(y, d.doc_id) AS kept
        FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least ON x = d.doc_id""",
}
