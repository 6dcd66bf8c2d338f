"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import conversations, decontaminate, language_model, lines, packing, periodic, pii, quality, simhash, substring, toxicity, url_filter, warc
from tidemark.llm.tables import table

Query = Callable[[SparkSession, str], DataFrame]


OP1_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
windows AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS k FROM w, UNNEST(range(1, len(ws) - 33)) AS t(i)),
twice AS (SELECT k FROM windows GROUP BY k HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, i + o AS p FROM windows JOIN twice USING (k), range(35) AS r(o)),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""


def op1_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.dedup_substrings(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages carry no fetch time and there is no list, so both are derived from ``pages``: a page is
    fetched on a day that its id gives; at each month's end every domain, host and first path
    segment is listed, to be blocked if most of its captures of the month came over plain http."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.expr("cast(pmod(page_id * 37, 360) as int)").alias("fetched"))
    seen = pages.select("fetched", F.startswith("url", F.lit("http:")).cast("int").alias("plain"), F.explode(url_filter.patterns(F.col("url"), 1)).alias("p"))
    months = seen.groupBy("p.pattern", F.expr("fetched div 30").alias("month"))
    entries = months.agg(F.expr("if(2 * sum(plain) > count(*), 'block', 'allow')").alias("action"))
    listed = entries.select("pattern", "action", F.expr("cast(30 * (month + 1) as int)").alias("listed"))
    return url_filter.judge(pages, listed)


OP3_SQL = """
WITH pages0 AS (
  SELECT page_id, url, CAST(page_id * 37 % 360 AS INTEGER) AS fetched,
         lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)) AS host,
         list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '/'), lambda x: x <> '') AS segs
  FROM pages),
asked AS (
  SELECT page_id, fetched, url, array_to_string(list_slice(string_split(host, '.'), k, len(string_split(host, '.'))), '.') AS pattern, len(string_split(host, '.')) - k + 1 AS rank
  FROM pages0, UNNEST(range(1, greatest(len(string_split(host, '.')), 2))) AS t(k) WHERE host <> ''
  UNION ALL
  SELECT page_id, fetched, url, host || '/' || array_to_string(list_slice(segs, 1, k), '/'), 100 * k
  FROM pages0, UNNEST(range(1, least(len(segs), 2) + 1)) AS t(k) WHERE host <> ''),
entries AS (
  SELECT pattern, CASE WHEN 2 * sum(CASE WHEN url LIKE 'http:%' THEN 1 ELSE 0 END) > count(*) THEN 'block' ELSE 'allow' END AS action,
         CAST(30 * (fetched // 30 + 1) AS INTEGER) AS since
  FROM asked WHERE rank < 200 GROUP BY pattern, fetched // 30),
held AS (SELECT *, lead(since) OVER (PARTITION BY pattern ORDER BY since) AS until FROM entries),
hits AS (
  SELECT page_id, action, a.pattern, since, row_number() OVER (PARTITION BY page_id ORDER BY rank DESC) AS rn
  FROM asked a JOIN held h ON a.pattern = h.pattern AND h.since <= a.fetched AND (h.until IS NULL OR h.until > a.fetched))
SELECT p.page_id, p.fetched, coalesce(h.action, 'allow') <> 'block' AS kept, h.action, h.pattern, h.since
FROM pages0 p LEFT JOIN hits h ON p.page_id = h.page_id AND h.rn = 1
"""


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)
    return pieces.drop("ids")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"), masked=False)
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


OP8_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS k FROM documents WHERE text IS NOT NULL),
s AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS p FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
runs AS (SELECT doc_id, p, w, line AS a, lead(line) OVER x AS b, w + lead(w) OVER x AS w2, lead(line, 2) OVER x AS c FROM s WINDOW x AS (PARTITION BY doc_id ORDER BY p)),
later AS (
  SELECT doc_id, p, 3 AS d FROM (SELECT *, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, p) AS n FROM runs WHERE c IS NOT NULL) WHERE n > 1
  UNION ALL SELECT doc_id, p, 2 FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY doc_id, p) AS n FROM runs WHERE b IS NOT NULL AND w2 >= 50) WHERE n > 1
  UNION ALL SELECT doc_id, p, 1 FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY doc_id, p) AS n FROM runs WHERE w >= 50) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, p + o AS p FROM later, range(3) AS r(o) WHERE o < d),
islands AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS g FROM gone) GROUP BY doc_id, g),
totals AS (SELECT doc_id, sum(n) AS n_removed, max(n) AS longest_run FROM islands GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY k) AS text FROM l WHERE (doc_id, k) NOT IN (SELECT (s.doc_id, s.k) FROM s JOIN gone USING (doc_id, p)) GROUP BY doc_id),
counted AS (SELECT doc_id, count(*) AS n_lines FROM s GROUP BY doc_id),
firsts AS (SELECT doc_id, p, first_value(doc_id) OVER x AS fd, first_value(p) OVER x AS fp FROM runs WHERE c IS NOT NULL WINDOW x AS (PARTITION BY a, b, c ORDER BY doc_id, p)),
chained AS (SELECT *, lag(p) OVER x AS p0, lag(fd) OVER x AS fd0, lag(fp) OVER x AS fp0 FROM firsts WHERE fd <> doc_id OR fp <> p WINDOW x AS (PARTITION BY doc_id ORDER BY p)),
starts AS (SELECT * FROM chained WHERE NOT coalesce(p0 = p - 1 AND fd0 = fd AND fp0 = fp - 1, false)),
lengths AS (
  SELECT t.doc_id, t.p, t.fd, coalesce(min(x.p) FILTER (y.line IS NULL OR y.line <> x.line), max(x.p) + 1) - t.p AS n
  FROM starts t JOIN s x ON x.doc_id = t.doc_id AND x.p >= t.p LEFT JOIN s y ON y.doc_id = t.fd AND y.p = t.fp + x.p - t.p GROUP BY t.doc_id, t.p, t.fd),
copies AS (SELECT doc_id, count(*) AS n_runs, max(n) AS longest_copy, (list(fd ORDER BY n DESC, p))[1] AS copied_from FROM lengths GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS INTEGER) AS n_lines, CAST(coalesce(n_removed, 0) AS INTEGER) AS n_removed, CAST(coalesce(longest_run, 0) AS INTEGER) AS longest_run,
       CASE WHEN n_removed IS NULL THEN 1.0 ELSE len(regexp_extract_all(coalesce(kept.text, ''), '[^\x20\x09-\x0D]+')) / greatest(1, len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+'))) END AS "left",
       CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(kept.text, '')) END AS kept_sha256,
       coalesce(n_runs, 0) AS n_runs, coalesce(longest_copy, 0) AS longest_copy, copied_from
FROM documents d LEFT JOIN counted USING (doc_id) LEFT JOIN totals USING (doc_id) LEFT JOIN kept USING (doc_id) LEFT JOIN copies USING (doc_id)
"""


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", "longest_run", "left", F.sha2("kept_text", 256).alias("kept_sha256"), "n_runs", "longest_copy", "copied_from")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance2")


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archived(table(spark, sf_dir, "pages"))
    sound = F.when(F.col("error").isNotNull(), F.raise_error(F.concat_ws(" ", "file", "offset", "error")).cast("string")).otherwise(F.col("record_type"))
    return found.select("page_id", "payload_bytes", "payload_digest", sound.alias("record_type"), F.col("refers_to_page").alias("refers_to"))


OP11_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
m AS (SELECT *, CASE WHEN strlen(html) >= 1000 THEN max(page_id) OVER (PARTITION BY html) END AS most FROM p),
r AS (SELECT *, CASE WHEN page_id < most OR (page_id IS NULL AND most IS NOT NULL) THEN most END AS refers_to FROM m)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM r
"""


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents are given periodic tails before runs are looked for."""
    found = periodic.periodic_runs(table(spark, sf_dir, "documents"), looped=True)
    each = "concat(x.start, ',', x.length, ',', x.period, chr(10))"
    # the greatest exact length / period, compared by cross products; ties: smallest start, then period
    first = "x.length * best.period > best.length * x.period or (x.length * best.period = best.length * x.period and (x.start < best.start or (x.start = best.start and x.period < best.period)))"
    best = F.expr(f"aggregate(runs, cast(null as struct<start: bigint, length: bigint, period: bigint>), (best, x) -> if(best is null or {first}, x, best))")
    found = found.withColumn("best", best)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.expr(f"array_join(transform(runs, x -> {each}), '')"), 256).alias("runs_sha256"), F.sha2("collapsed_text", 256).alias("collapsed_sha256"),
    )


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damage(table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Query] = {
    "op1_substring": op1_substring,
    "op2_language_model": op2_language_model,
    "op3_url_filter": op3_url_filter,
    "op4_decontaminate": op4_decontaminate,
    "op5_packing": op5_packing,
    "op6_simhash": op6_simhash,
    "op7_pii": op7_pii,
    "op8_lines": op8_lines,
    "op9_toxicity": op9_toxicity,
    "op10_quality": op10_quality,
    "op11_warc": op11_warc,
    "op12_periodic": op12_periodic,
    "op13_conversations": op13_conversations,
}

ORACLES: dict[str, str] = {"op1_substring": OP1_SQL, "op3_url_filter": OP3_SQL, "op8_lines": OP8_SQL, "op11_warc": OP11_SQL}
