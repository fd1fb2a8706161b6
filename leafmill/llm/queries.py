"""The operators' queries, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import audit, decontaminate, lines, lm, manifest, mix, near, qda, repeats, rules, secrets, token_ids, warc
from leafmill.llm.common import table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.secret_spans(table(spark, sf_dir, "documents")))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(table(spark, sf_dir, "documents"), size=4)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qda.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.sha2(F.array_join("items", ","), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_scores(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.archive_pages(table(spark, sf_dir, "pages"))
    return out.filter(F.col("kind") == "record").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids.token_ids(table(spark, sf_dir, "documents"), TOKENIZER)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.suffix_dedup(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.digest(manifest.audit(table(spark, sf_dir, "documents")))


_ALL = (
    op1_secret_scan, op2_mixing, op3_near_dedup, op4_quality_rules, op5_quality_classifier, op6_decontamination, op7_line_dedup, op8_lm_scoring, op9_warc, op10_token_ids,
    op11_filter_audit, op12_suffix_dedup, op13_manifest,
)
QUERIES = {f.__name__: f for f in _ALL}

# The SQL shares only fixed values with the operators: patterns, thresholds and characters.

_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_KEY = _LOW.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")
_BLANK_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_BENCH_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')".format(_LOW.format("coalesce(text, '')"))


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _found(kind: int, pattern: str, group: int = 0) -> str:
    p = _quoted(pattern)
    return f"""SELECT doc_id, {kind} AS kind, unnest(range(1, len(h) + 1)) AS n, unnest(h) AS hit, unnest(v) AS value, unnest(b[:len(h)]) AS before
            FROM (SELECT doc_id, regexp_extract_all(t, {p}) AS h, regexp_extract_all(t, {p}, {group}) AS v, string_split_regex(t, {p}) AS b FROM d)"""


_ALLOWED = " OR ".join(f"regexp_matches(value, {_quoted(p)})" for p in secrets.ALLOW)
_MASKED = "value"
for _word in secrets.HOLDERS:
    _MASKED = f"regexp_replace({_MASKED}, '{_word}', '{' ' * len(_word)}', 'gi')"
_LEAST = " ".join(f"WHEN regexp_matches(value, {_quoted(p)}) THEN {v}" for p, v in secrets.CLASSES.items())

#: Unsigned CRC-32 of a short text: each byte, then eight steps, folded over one list.
_CRC = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten([[ord(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] for x in string_split({}, '')])), lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"


def _manifest_sql(levels: int = 7, tops: int = 3) -> str:
    """Levels are written out: 8^7 documents of a language, 8^3 languages at most.  l and t are nodes, ls and ts their siblings
    (null where the group has one node), w the walk of each leaf up its path."""

    def siblings(group: str, frame: str) -> str:
        return f"CASE WHEN n > 1 THEN coalesce(string_agg(h, '') OVER (PARTITION BY {group}, i // 8 ORDER BY i ROWS BETWEEN {frame}), '') END"

    def tree(p: str, group: str, count: int) -> str:
        return ",".join(
            f"""{p}s{k} AS (SELECT {group}, i, {siblings(group, "UNBOUNDED PRECEDING AND 1 PRECEDING")} AS b, {siblings(group, "1 FOLLOWING AND UNBOUNDED FOLLOWING")} AS a FROM {p}{k}),
        {p}{k + 1} AS (SELECT {group}, i // 8 AS i, (max(n) + 7) // 8 AS n, CASE WHEN max(n) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE max(h) END AS h FROM {p}{k} GROUP BY {group}, i // 8)"""
            for k in range(count)
        )

    said = lambda column: f"coalesce(strlen({column}::VARCHAR) || ':' || {column}::VARCHAR, '-')"
    leaf = "sha256(" + " || ".join(said(c) for c in ("doc_id", "source", "lang", "n_chars")) + " || {})"
    low = f"CASE WHEN {_CRC.format('doc_id::VARCHAR')} % 3 = 0 THEN {said(_LOW.format('text'))} ELSE {said('text')} END"
    steps = [(f"ls{k}", "lang", f"w.i // {8**k}") for k in range(levels)] + [(f"ts{k}", "one", f"w.g // {8**k}") for k in range(tops)]
    walk = ",".join(
        f"w{j} AS (SELECT w.* REPLACE (w.p || coalesce(s.b || s.a, '') AS p, coalesce(sha256(s.b || w.f || s.a), w.f) AS f) FROM w{j - 1} w JOIN {t} s ON s.{group} IS NOT DISTINCT FROM w.{group} AND s.i = {at})"
        for j, (t, group, at) in enumerate(steps, 1)
    )
    return f"""
        WITH leaves AS MATERIALIZED (SELECT doc_id, lang, {leaf.format(said("text"))} AS h, {leaf.format(low)} AS f FROM documents),
        placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
        l0 AS (SELECT lang, i, n, h FROM placed),
        {tree("l", "lang", levels)},
        t0 AS (SELECT 1 AS one, lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n, h FROM l{levels}),
        {tree("t", "one", tops)},
        w0 AS (SELECT p.doc_id, p.lang, p.i, p.h, p.f, '' AS p, 1 AS one, t0.i AS g, t0.h AS subroot FROM placed p JOIN t0 ON p.lang IS NOT DISTINCT FROM t0.lang),
        {walk}
        SELECT doc_id, w.h AS leaf, subroot, t.h AS root, sha256(p) AS proof_sha256, f AS folded_root, f = t.h AS verified FROM w{levels + tops} w, t{tops} t"""


SQL = {
    "op1_secret_scan": f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        found AS ({_found(0, secrets.ASSIGN, 2)} UNION ALL {_found(1, secrets.PATTERNS["access"])} UNION ALL {_found(2, secrets.PATTERNS["hex"])} UNION ALL {_found(3, secrets.CANDIDATE)}),
        placed AS (SELECT *, sum(length(before) + length(hit)) OVER (PARTITION BY doc_id, kind ORDER BY n) AS stop FROM found),
        base AS (SELECT doc_id, kind, stop - length(hit) AS start, stop FROM placed WHERE kind < 3 AND (kind > 0 OR length(value) >= {secrets.LEAST_VALUE})),
        runs AS (SELECT doc_id, stop - length(hit) AS start, {_MASKED} AS value, CASE {_LEAST} END AS least FROM placed WHERE kind = 3 AND NOT ({_ALLOWED})),
        windows AS (SELECT doc_id, start, value, least, unnest(range(0, length(value) - {secrets.WINDOW - 1})) AS i FROM runs),
        high AS (SELECT * FROM windows WHERE NOT contains(substr(value, i + 1, {secrets.WINDOW}), ' ') AND list_aggregate(string_split(substr(value, i + 1, {secrets.WINDOW}), ''), 'entropy') >= least),
        spans AS (SELECT * FROM base UNION ALL SELECT doc_id, 3, start + min(i), start + max(i) + {secrets.WINDOW} FROM high GROUP BY doc_id, start),
        said AS (SELECT *, ['assign', 'access', 'hex', 'entropy'][kind + 1] || ':' || start::BIGINT || ':' || stop::BIGINT AS s FROM spans)
        SELECT d.doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
               sha256(coalesce(string_agg(s, ',' ORDER BY start, kind) FILTER (kind < 3), '')) AS base_sha256, coalesce(string_agg(s, ',' ORDER BY start, kind), '') AS spans
        FROM d LEFT JOIN said USING (doc_id) GROUP BY d.doc_id""",
    "op3_near_dedup": f"""
        WITH RECURSIVE w AS (SELECT doc_id, {_BLANK_WORDS.format(_LOW.format("coalesce(text, '')"))} AS w FROM documents),
        s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 4 THEN [array_to_string(w[i:i + 3], ' ') for i in range(1, len(w) - 2)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
        sets AS (SELECT min(doc_id) AS rep, list_sort(s) AS s FROM s GROUP BY list_sort(s)),
        each AS (SELECT rep, len(s) AS n, unnest(s) AS x FROM sets),
        pairs AS (SELECT a.rep AS a, b.rep AS b, a.n AS n, b.n AS m, count(*) AS k FROM each a JOIN each b ON a.x = b.x AND a.rep <> b.rep AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n) GROUP BY ALL),
        links AS (SELECT a, b FROM pairs WHERE 100 * k >= 80 * (n + m - k)),
        reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
        least AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
        of AS (SELECT doc_id, len(s.s) AS n, CASE WHEN len(s.s) = 0 THEN doc_id ELSE least(sets.rep, coalesce(least.b, sets.rep)) END AS c FROM s JOIN sets ON sets.s = list_sort(s.s) LEFT JOIN least ON least.a = sets.rep)
        SELECT doc_id, n AS n_shingles, c AS component_id, doc_id = c AS kept FROM of""",
    "op6_decontamination": f"""
        WITH items AS (SELECT item_id::VARCHAR AS item, {_BENCH_WORDS} AS w FROM benchmark),
        windows AS (SELECT DISTINCT item, len(x) AS size, array_to_string(x, ' ') AS x FROM (SELECT item, w[i:i + 9] AS x FROM items, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS r(i) WHERE len(w) > 0)),
        d AS (SELECT doc_id, {_BENCH_WORDS} AS w FROM documents),
        sizes AS (SELECT DISTINCT size FROM windows),
        places AS (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS x FROM d, sizes, unnest(range(1, len(w) - size + 2)) AS r(i)),
        hits AS (SELECT doc_id, item, i, p.size FROM places p JOIN windows ON p.size = windows.size AND p.x = windows.x),
        inside AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS j FROM hits) GROUP BY doc_id),
        of AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM d LEFT JOIN inside USING (doc_id) LEFT JOIN of USING (doc_id)""",
    "op7_line_dedup": f"""
        WITH lines AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
            FROM documents),
        keyed AS (SELECT *, {_KEY} AS k FROM lines),
        shared AS (
            SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
        marked AS (
            SELECT keyed.*, shared.k IS NOT NULL AND doc_id <> keeper AS gone FROM keyed LEFT JOIN shared ON keyed.k = shared.k)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id""",
    "op9_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), k AS (SELECT *, sha1(h) AS s, max(page_id) OVER (PARTITION BY h) AS top FROM p)
        SELECT page_id, strlen(h) AS payload_bytes,
               array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(s, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31), 1) for i in range(0, 32)], '') AS payload_digest,
               CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
        FROM k""",
    "op11_filter_audit": r"""
        WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
        w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, rank() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST) > 1 AND doc_id IS NOT NULL AS copy FROM d),
        f AS (SELECT doc_id, part, {A: len(w) < 200, B: 100 * len(list_distinct(w)) < 50 * len(w), C: 100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t), D: regexp_matches(t, '[#$%&*|]'), E: copy} AS f FROM w),
        l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
        one AS (SELECT part, [x FOR x IN ['A', 'B', 'C', 'D', 'E'] IF [f.A, f.B, f.C, f.D, f.E][ord(x) - 64]] AS fails, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM f LEFT JOIN l USING (doc_id)),
        cells AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM one GROUP BY ALL),
        x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
        orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
        steps AS (SELECT o, s::INT AS step, o[s] AS letter, string_split(o[1:s - 1], '') AS before FROM orders, range(1, 6) r(s)),
        counted AS (
            SELECT part, o AS filter_order, step, letter, sum(n) FILTER (NOT list_has_any(fails, list_append(before, letter))) AS kept,
                   sum(n) FILTER (here) AS removed, sum(n) FILTER (list_contains(fails, letter) AND list_has_any(fails, before)) AS redundant, sum(n) FILTER (fails = [letter]) AS unique_fails,
                   sum(good) FILTER (here) AS good_lost, sum(toxic) FILTER (here) AS toxic_lost
            FROM (SELECT *, list_contains(fails, letter) AND NOT list_has_any(fails, before) AS here FROM cells, steps) GROUP BY ALL)
        SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
               coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, letter), 0)::BIGINT AS shapley
        FROM counted""",
    "op13_manifest": _manifest_sql(),
}
