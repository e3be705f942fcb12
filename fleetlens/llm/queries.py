"""The registered queries of the corpus operators, and their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import (closed_syncmers, curriculum_mix, cutting_stock, deleted_interp, exact_dedup,
                           host_reputation, jaccard_groups, jacobi_davidson, langid_ecoc, pii_crf, topk_hist,
                           toxicity_subword, variable_grams)
from fleetlens.llm.common import crc_mod, documents
from fleetlens.plans.base import half_away_round

TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
#: verdict, host, path
URL_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"),
             ("allow", "org", "/fr/"))
TOXIC_FROM = 0.7


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = crc_mod("doc_id", 5) == 0
    out = langid_ecoc.identify(docs, learn=~held)
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "margin", "ambiguous")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir), keep="max")


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return topk_hist.top_k(vectors, F.col("vec_id") % 50 == 0, k=5)


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deleted_interp.lm_scores(documents(spark, sf_dir), held=crc_mod("doc_id", 7) == 2)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups.jaccard_components(documents(spark, sf_dir), words=3, percent=90)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_crf.find_pii(documents(spark, sf_dir))

    def listed(c: str):
        return F.concat_ws(",", F.transform(c, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in pii_crf.KINDS]
    return found.select("doc_id", *counts, F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"),
                        listed("spans").alias("spans"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return host_reputation.judge_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cutting_stock.pack(documents(spark, sf_dir), tokenizer_path(), tokenizer_path(RANKS))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = crc_mod("doc_id", 3) == 1
    out = toxicity_subword.toxicity(docs, labels, learn=~held)
    return out.select("doc_id", held.alias("held_out"), "score",
                      (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = curriculum_mix.plan_mix(documents(spark, sf_dir))
    return out.select("doc_id", "size", "source_size", half_away_round(F.col("target")).alias("target"), "taken",
                      half_away_round(F.get("positions", F.lit(0))).alias("position"))


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return closed_syncmers.fingerprints(documents(spark, sf_dir))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variable_grams.spelling_variants(documents(spark, sf_dir))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jacobi_davidson.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=16)


QUERIES = {f.__name__: f for f in (op1_language_id, op2_exact_dedup, op3_top_k, op4_lm_score, op5_jaccard_join,
                                   op6_pii, op7_url_filter, op8_packing, op9_toxicity, op10_mixing,
                                   op11_fingerprints, op12_spelling_variants, op13_whitening)}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
#: one ASCII symbol for each letter beyond ASCII, so that distances in bytes are distances in letters
_ONE_BYTE = "translate({}, '" + "".join(map(chr, range(0xC0, 0x100))) + "', '" \
    + "".join(map(chr, range(33, 97))).replace("'", "''") + "')"

ORACLE = {
    "op2_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op3_top_k": """
        WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings
                   WHERE len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
        t AS (SELECT vec_id, i, floor(256 * x)::BIGINT AS x FROM v),
        s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, sum(q.x * c.x)::BIGINT AS score
              FROM t q JOIN t c ON q.i = c.i AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op5_jaccard_join": f"""
        WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS ws FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
              ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))
              END AS sh FROM w),
        t AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c
              FROM t a JOIN t b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
        l AS (SELECT a, b FROM p WHERE 100 * c >= 90 * (na + nb - c)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        reach AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
        c AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
        SELECT doc_id, len(sh)::BIGINT AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id
        FROM s LEFT JOIN c ON c.a = s.doc_id""",
    "op7_url_filter": r"""
        WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                          regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
        m AS (SELECT *, CASE
                WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
                WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
                WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
                WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM p),
        l AS (SELECT *, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 1 WHEN rule IS NOT NULL THEN 0 END AS bad FROM m),
        h AS (SELECT host, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS bad, split_part(host, '.', -1) AS suffix,
                     array_to_string(list_slice(string_split(host, '.'), greatest(len(string_split(host, '.')) - 1, 1),
                                                len(string_split(host, '.'))), '.') AS domain FROM l GROUP BY host),
        d AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL),
        s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY ALL),
        a AS (SELECT 'h' AS lvl, n, bad FROM h WHERE n > 0 UNION ALL SELECT 'd', n, bad FROM d WHERE n > 0
              UNION ALL SELECT 's', n, bad FROM s WHERE n > 0),
        b AS (SELECT lvl, count(*) AS g, sum(n) AS n, sum(bad) AS bad, sum(n * n) AS nn,
                     sum(bad * (1 - bad / n)) AS w, sum(bad * bad / n) AS raw FROM a GROUP BY lvl),
        v AS (SELECT lvl, g, n, (raw - bad * bad / n) / nullif(g - 1, 0) AS msb, w / nullif(n - g, 0) AS msw,
                     (n - nn / n) / nullif(g - 1, 0) AS n0 FROM b),
        k AS (SELECT lvl, CASE WHEN g < 2 OR n <= g THEN 1.0
                               WHEN coalesce((msb - msw) / nullif(msb + (n0 - 1) * msw, 0), 0) <= 0 THEN 1000.0
                               ELSE least(greatest((1 - (msb - msw) / (msb + (n0 - 1) * msw))
                                                   / ((msb - msw) / (msb + (n0 - 1) * msw)), 1.0), 1000.0) END AS k FROM v),
        kk AS (SELECT coalesce(max(k) FILTER (lvl = 's'), 1.0) AS ks, coalesce(max(k) FILTER (lvl = 'd'), 1.0) AS kd,
                      coalesce(max(k) FILTER (lvl = 'h'), 1.0) AS kh FROM k),
        base AS (SELECT coalesce(sum(bad) / nullif(sum(n), 0), 0) AS base FROM s),
        sr AS (SELECT suffix, (bad + ks * base) / (n + ks) AS r FROM s, kk, base),
        dr AS (SELECT d.suffix, domain, (bad + kd * r) / (n + kd) AS r FROM d JOIN sr USING (suffix), kk),
        hr AS (SELECT host, n, (bad + kh * r) / (n + kh) AS r, kh FROM h JOIN dr USING (suffix, domain), kk)
        SELECT page_id, l.host, path, rule,
               CASE WHEN bad = 1 THEN 'block' WHEN bad = 0 THEN 'allow'
                    WHEN hr.r - 1.645 * sqrt(hr.r * (1 - hr.r) / (hr.n + hr.kh + 1)) > 0.5 THEN 'block'
                    ELSE 'allow' END AS verdict
        FROM l JOIN hr ON l.host = hr.host""",
    "op10_mixing": f"""
        WITH d AS (SELECT doc_id, source, len({_WORDS.format("coalesce(text, '')")})::BIGINT AS size,
                          md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
        i AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM s),
        w AS (SELECT *, (i % 3 + 1)::DOUBLE AS w, 3.0::DOUBLE * source_size AS cap,
                     [-0.5, 0.0, 0.5][(i % 3 + 1)::INT]::DOUBLE AS slope FROM i),
        f AS (SELECT *, (sum(source_size) OVER ()
                         - coalesce(sum(cap) OVER (ORDER BY cap / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                     / (sum(w) OVER ()
                        - coalesce(sum(w) OVER (ORDER BY cap / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                     AS level FROM w),
        o AS (SELECT (SELECT level FROM f WHERE w * level <= cap ORDER BY cap / w, i LIMIT 1) AS level),
        t AS (SELECT source, source_size, slope, least(cap, coalesce(w * o.level, cap)) AS target FROM f, o),
        c AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead FROM d),
        x AS (SELECT c.*, t.source_size, t.target, t.slope,
                     CASE WHEN source_size > 0 THEN floor(target / source_size)::INT ELSE 0 END AS whole
              FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source),
        y AS (SELECT *, CASE WHEN size = 0 THEN 0 ELSE whole
                     + (ahead + size / 2.0::DOUBLE < target - whole * source_size)::INT END AS takes FROM x),
        z AS (SELECT *, CASE WHEN takes > 0 THEN least((ahead + size / 2.0::DOUBLE) / target, 1.0::DOUBLE) END AS u FROM y)
        SELECT doc_id, size, source_size, round(target, 6) AS target, (size * takes)::BIGINT AS taken,
               round(CASE WHEN slope = 0 OR u IS NULL THEN u ELSE least(greatest(
                   (sqrt((1 - slope) * (1 - slope) + 4 * slope * u) - (1 - slope)) / (2 * slope), 0), 1) END, 6) AS position
        FROM z""",
    "op12_spelling_variants": f"""
        WITH RECURSIVE r AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run
                             FROM documents WHERE text IS NOT NULL),
        l AS (SELECT id, {_LOWER.format("run")} AS run, count(*) AS c FROM r WHERE length(run) >= 5 GROUP BY ALL),
        crc AS (SELECT list(v ORDER BY i) AS steps FROM (SELECT i, list_reduce([i::UBIGINT] || range(8)::UBIGINT[],
                lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::UBIGINT) ELSE a >> 1 END) AS v FROM range(256) x(i))),
        b AS (SELECT *, hex(encode(id || ':' || run)) AS hx FROM l),
        h AS (SELECT run, c, xor(list_reduce([4294967295::UBIGINT] || list_transform(range(1, length(hx), 2),
                lambda i: ('0x' || substr(hx, i, 2))::UBIGINT), lambda a, x: xor(a >> 8, steps[((xor(a, x) & 255) + 1)::BIGINT])),
                4294967295::UBIGINT) AS h FROM b, crc),
        w AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2)
                     ELSE run END AS word, c FROM h),
        v AS (SELECT word, sum(c)::BIGINT AS n FROM w WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
        k AS (SELECT DISTINCT word, n, unnest([word] || list_transform(range(1, length(word) + 1),
                lambda i: substr(word, 1, i - 1) || substr(word, i + 1))) AS k FROM v),
        p AS (SELECT DISTINCT a.word, b.word AS other, b.n FROM k a JOIN k b ON a.k = b.k AND a.word <> b.word
              WHERE levenshtein({_ONE_BYTE.format("a.word")}, {_ONE_BYTE.format("b.word")}) = 1),
        m AS (SELECT word, count(*) AS n_near, max(n) AS top FROM p GROUP BY word),
        f AS (SELECT p.word, m.n_near, m.top, min(p.other) AS best FROM p JOIN m ON m.word = p.word AND m.top = p.n GROUP BY ALL),
        o AS (SELECT v.word, v.n, coalesce(f.n_near, 0)::BIGINT AS n_near, CASE WHEN f.top >= 2 * v.n THEN f.best END AS form,
                     CASE WHEN f.top >= 2 * v.n THEN f.top END AS form_n FROM v LEFT JOIN f ON f.word = v.word),
        s AS (SELECT word, word AS root FROM o UNION ALL SELECT s.word, o.form FROM s JOIN o ON o.word = s.root
              WHERE o.form IS NOT NULL)
        SELECT o.word, o.form, s.root, o.n, o.n_near, o.form_n
        FROM o JOIN s ON s.word = o.word JOIN o AS z ON z.word = s.root WHERE z.form IS NULL""",
}
