"""The registered queries of this subpackage, one opN_<name> an operator, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .bpe import bpe_encode
from .cap_filters import near_vectors
from .langid import fit_languages, predict_languages
from .licenses import TEMPLATES, license_scan, model
from .merkle import manifest, proof_digest
from .mixing import replicate
from .ngram_join import ngram_components
from .quality import fit_quality, quality_scores
from .secrets import secret_spans
from .span_dedup import remove_repeated_spans
from .spelling import spelling_variants
from .spotsigs import WORDS, edited_fingerprints
from .suffix_dedup import remove_repeats


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no paths: source/language/hundred/name stands for one. Every tenth is named as a licence file, every hundredth of its language's directory, every thousandth of its source's, so that
    ancestors at several depths are looked up."""
    docs = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    hundred, name = F.floor(i / 100).cast("string"), F.when(i % 10 == 0, F.concat(F.lit("LICENSE-"), i.cast("string"))).otherwise(F.concat(i.cast("string"), F.lit(".txt")))
    path = F.when(i % 1000 == 0, F.concat_ws("/", "source", name)).when(i % 100 == 0, F.concat_ws("/", "source", "lang", name)).otherwise(F.concat_ws("/", "source", "lang", hundred, name))
    return license_scan(docs.withColumn("path", path))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"))


def op3_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replicate(table(spark, sf_dir, "documents")).select("doc_id", "source", "copy", "n_chars", F.sha2("text", 256).alias("text_sha256"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), digests=True)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_scores(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), digest=True)


def op10_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op6_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_spans(table(spark, sf_dir, "documents"), digest=True)


def op7_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict_languages(docs, fit_languages(docs))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose id's CRC-32 is even are found with their texts' line breaks gone."""
    odd = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 1
    found = F.when(odd | F.col("doc_id").isNull(), F.col("text")).otherwise(F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    return manifest(table(spark, sf_dir, "documents"), {"text": found}).withColumn("proof_sha256", proof_digest(F.col("proof"))).drop("proof")


def _license_sql() -> str:
    idf, other, rows, _ = model()
    known = ", ".join(f"('{w}', {x!r}::DOUBLE)" for w, x in idf.items())
    units = ", ".join(f"({k}, '{w}', {x!r}::DOUBLE)" for k, w, x in rows)
    names = ", ".join(f"({k}, '{n}')" for k, (n, _) in enumerate(TEMPLATES))
    return f"""
        WITH k AS (SELECT * FROM (VALUES {known}) k(word, idf)), t AS (SELECT * FROM (VALUES {units}) t(template, word, unit)), n AS (SELECT * FROM (VALUES {names}) n(template, license)),
        l AS (SELECT doc_id, generate_subscripts(a, 1) AS line, unnest(a) AS body FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)),
        w AS (SELECT doc_id, line, word, count(*) AS n FROM (SELECT doc_id, line, unnest(regexp_split_to_array(lower(body), '[^a-z0-9]+')) AS word FROM l) WHERE word <> '' GROUP BY ALL),
        x AS (SELECT w.*, w.n * coalesce(k.idf, {other!r}::DOUBLE) AS w FROM w LEFT JOIN k USING (word)),
        z AS (SELECT doc_id, line, sqrt(sum(w * w)) AS size FROM x GROUP BY ALL),
        c AS (SELECT doc_id, template, max(round(dot / size, 6)) AS score FROM (SELECT doc_id, line, template, sum(w * unit) AS dot FROM x JOIN t USING (word) GROUP BY ALL) JOIN z USING (doc_id, line) GROUP BY ALL),
        o AS (SELECT doc_id, license, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, template) AS r FROM c WHERE score >= 0.75) JOIN n USING (template) WHERE r = 1),
        d AS (SELECT doc_id, doc_id % 10 = 0 AS is_file, CASE WHEN doc_id % 1000 = 0 THEN source WHEN doc_id % 100 = 0 THEN concat_ws('/', source, lang) ELSE concat_ws('/', source, lang, CAST(doc_id // 100 AS VARCHAR)) END AS folder FROM documents),
        g AS (SELECT folder, arg_min(license, 'LICENSE-' || CAST(doc_id AS VARCHAR)) AS granted FROM d JOIN o USING (doc_id) WHERE is_file GROUP BY folder),
        u AS (SELECT doc_id, folder, split_part(folder, '/', 1) AS f1, concat_ws('/', split_part(folder, '/', 1), split_part(folder, '/', 2)) AS f2 FROM d)
        SELECT u.doc_id, o.license, o.score, CASE WHEN o.license IS NULL THEN coalesce(a.folder, b.folder, c.folder) END AS directory, CASE WHEN o.license IS NULL THEN coalesce(a.granted, b.granted, c.granted) END AS inherited
        FROM u LEFT JOIN o USING (doc_id) LEFT JOIN g a ON a.folder = u.folder LEFT JOIN g b ON b.folder = u.f2 LEFT JOIN g c ON c.folder = u.f1
    """


def _spots(text: str) -> str:
    """SQL for the fingerprint of a text column."""
    common = ", ".join(f"'{w}'" for w in WORDS)
    words = f"list_filter(regexp_split_to_array(lower(coalesce({text}, '')), '[^\\pL\\pN]+'), lambda w: w <> '')"
    return f"""(SELECT array_to_string(CASE WHEN len(s) > 0 THEN list_sort(list_distinct(s)) ELSE [substr(md5('all ' || array_to_string(t, ' ')), 1, 8)] END, ' ') FROM (
        SELECT t, list_transform(list_filter(range(1, len(c)), lambda k: CASE WHEN k = 1 THEN c[1] > 1 ELSE c[k - 1] < c[k] - 1 END), lambda k: substr(md5(t[c[k] - 1] || ' ' || t[c[k]] || ' ' || t[c[k + 1]]), 1, 8)) AS s FROM (
        SELECT t, list_filter(range(1, len(t) + 1), lambda i: t[i] NOT IN ({common})) AS c FROM (SELECT {words} AS t))))"""


def _near(x: str, y: str) -> str:
    a, b = f"string_split({x}, ' ')", f"string_split({y}, ' ')"
    both = f"CAST(len(list_intersect({a}, {b})) AS DOUBLE)"
    return f"CASE WHEN {x} = {y} THEN 1.0::DOUBLE ELSE {both} / (len({a}) + len({b}) - {both}) END"


#: Two CTEs; the second holds the CRC-32 of the 256 single bytes, for _crc32().
CRC_TABLE = """
        crc_bits AS (SELECT k, k AS c, 0 AS n FROM range(256) r(k) UNION ALL SELECT k, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n + 1 FROM crc_bits WHERE n < 8),
        crc AS (SELECT list(c ORDER BY k) AS of FROM crc_bits WHERE n = 8)"""


def _crc32(text: str) -> str:
    """SQL for the unsigned CRC-32 of a text's UTF-8 bytes, null for null; needs CRC_TABLE and `crc` in FROM."""
    octets = f"list_transform(range(0, strlen({text})), lambda i: CAST('0x' || substr(hex(encode({text})), 2 * i + 1, 2) AS BIGINT))"
    return f"xor(4294967295, list_reduce({octets}, lambda c, b: xor(c >> 8, crc.of[xor(c & 255, b) + 1]), 4294967295::BIGINT))"


def _field(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


def _merkle_sql() -> str:
    leaf = lambda text: "sha256(" + " || ".join(_field(x) for x in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    return f"""
        WITH RECURSIVE {CRC_TABLE},
        z AS (SELECT doc_id, source, {leaf("text")} AS leaf, CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf("text")} END AS found FROM documents, crc),
        n AS (SELECT *, row_number() OVER (ORDER BY doc_id, leaf) AS rid, row_number() OVER (PARTITION BY source ORDER BY doc_id, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS size FROM z),
        t AS (SELECT source, 0 AS lvl, i, size, leaf AS h FROM n UNION ALL SELECT source, lvl + 1, i // 3, (size + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE size > 1 GROUP BY source, lvl, i // 3, size),
        s AS (SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS size FROM t WHERE size = 1),
        u AS (SELECT 0 AS lvl, i, size, h FROM s UNION ALL SELECT lvl + 1, i // 3, (size + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM u WHERE size > 1 GROUP BY lvl, i // 3, size),
        e AS (
            SELECT n.rid, t.lvl, t.i, t.h, n.i // CAST(pow(3, t.lvl) AS BIGINT) AS own FROM n JOIN t ON t.source IS NOT DISTINCT FROM n.source AND t.size > 1 AND t.i // 3 = n.i // CAST(pow(3, t.lvl + 1) AS BIGINT)
            UNION ALL SELECT n.rid, 100 + u.lvl, u.i, u.h, s.i // CAST(pow(3, u.lvl) AS BIGINT) FROM n JOIN s ON s.source IS NOT DISTINCT FROM n.source JOIN u ON u.size > 1 AND u.i // 3 = s.i // CAST(pow(3, u.lvl + 1) AS BIGINT)
        ),
        p AS (SELECT rid, sha256(string_agg(h, '' ORDER BY lvl, i)) AS proof FROM e WHERE i <> own GROUP BY rid),
        k AS (SELECT rid, row_number() OVER (PARTITION BY rid ORDER BY lvl) AS step, coalesce(string_agg(h, '' ORDER BY i) FILTER (i < own), '') AS l, coalesce(string_agg(h, '' ORDER BY i) FILTER (i > own), '') AS r FROM e GROUP BY rid, lvl),
        f AS (SELECT rid, 1 AS step, found AS h FROM n UNION ALL SELECT f.rid, f.step + 1, sha256(k.l || f.h || k.r) FROM f JOIN k ON k.rid = f.rid AND k.step = f.step),
        g AS (SELECT rid, arg_max(h, step) AS folded FROM f GROUP BY rid), o AS (SELECT h AS root FROM u WHERE size = 1)
        SELECT n.doc_id, n.leaf, s.h AS subroot, o.root, coalesce(p.proof, sha256('')) AS proof_sha256, g.folded AS folded_root, g.folded = o.root AS verified
        FROM n JOIN s ON s.source IS NOT DISTINCT FROM n.source JOIN g USING (rid) LEFT JOIN p USING (rid), o
    """


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_poisson_mixing": op3_poisson_mixing,
    "op4_bpe": op4_bpe,
    "op5_quality": op5_quality,
    "op6_sentence_spans": op6_sentence_spans,
    "op7_spotsigs": op7_spotsigs,
    "op8_secrets": op8_secrets,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_cap_filters": op10_cap_filters,
    "op11_language_id": op11_language_id,
    "op12_spelling": op12_spelling,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLES = {
    "op1_license_scan": _license_sql(),
    "op2_ngram_jaccard": """
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents
        ), s AS (
            SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
                                             WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w
        ), e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS t FROM s),
        p AS (
            SELECT x.doc_id AS a, y.doc_id AS b FROM e x JOIN e y ON x.t = y.t AND x.doc_id < y.doc_id
            GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))
        ), l AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
        r AS (SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id)
        SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, m.component_id FROM s JOIN (SELECT id, min(c) AS component_id FROM r GROUP BY id) m ON m.id = s.doc_id
    """,
    "op3_poisson_mixing": """
        WITH s AS (SELECT coalesce(source, chr(0)) AS s, count(*) AS n FROM documents GROUP BY 1),
        r AS (SELECT s, (pow(CAST(n AS DOUBLE), 0.5) * (SELECT sum(n) FROM s) / (SELECT sum(pow(CAST(n AS DOUBLE), 0.5)) FROM s)) / n AS rate FROM s),
        p AS (SELECT s, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY s ORDER BY k) AS below FROM r, range(0, 200) g(k)),
        u AS (SELECT doc_id, source, n_chars, sha256(text) AS text_sha256, (CAST('0x' || substr(sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':1'), 1, 13) AS BIGINT) + 0.5) / 4503599627370496 AS u FROM documents),
        c AS (SELECT doc_id, source, n_chars, text_sha256, (SELECT count(*) FROM p WHERE p.s = coalesce(u.source, chr(0)) AND p.below < u.u AND p.k < 60) AS many FROM u)
        SELECT doc_id, source, CAST(g.copy AS INTEGER) AS copy, n_chars, text_sha256 FROM c, range(0, 60) g(copy) WHERE g.copy < many
    """,
    "op10_cap_filters": """
        WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        g AS (SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
        p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id < b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
        l AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
        r AS (SELECT vec_id AS id, vec_id AS c FROM v UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id),
        m AS (SELECT id, min(c) AS c FROM r GROUP BY id)
        SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id) AS n_links, m.c AS component_id, v.vec_id = m.c AS kept FROM v JOIN m ON m.id = v.vec_id
    """,
    "op7_spotsigs": f"""
        WITH o AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lead(coalesce(text, '')) OVER w, first_value(coalesce(text, '')) OVER w) AS nxt FROM documents WINDOW w AS (ORDER BY doc_id, text ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
        e AS (SELECT *, left(text, length(text) - length(text) // 2) || left(nxt, length(text) // 2) AS edited FROM o),
        f AS (SELECT doc_id, length(text) AS n_chars, sha256(edited) AS edited_sha256, {_spots("text")} AS fingerprint, {_spots("edited")} AS edited_fingerprint, {_spots("nxt")} AS nx FROM e)
        SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, {_near("fingerprint", "edited_fingerprint")} AS near_edited, {_near("fingerprint", "nx")} AS near_next FROM f
    """,
    "op11_language_id": f"""
        WITH RECURSIVE {CRC_TABLE},
        d AS (SELECT row_number() OVER () AS rid, doc_id, text, lang, {_crc32("CAST(doc_id AS VARCHAR)")} % 3 = 1 AS held_out FROM documents, crc),
        a AS (SELECT rid, word, count(*) AS n FROM (SELECT rid, unnest(regexp_extract_all(lower(text), '\\p{{L}}{{1,64}}')) AS word FROM d) GROUP BY ALL),
        c AS (SELECT lang, word, sum(n) AS n FROM a JOIN d USING (rid) WHERE NOT held_out AND lang IS NOT NULL GROUP BY ALL),
        l AS (SELECT lang, sum(n) AS size FROM c GROUP BY lang ORDER BY size DESC, lang LIMIT 256),
        m AS (SELECT greatest(1, least(524288 // (5 * count(*)), 33554432 // (5 * count(*) * count(*)))) AS most FROM l),
        s AS (SELECT word, k, CASE WHEN k > 1 THEN ' ' || word || ' ' ELSE word END AS whole FROM (SELECT DISTINCT word FROM a), range(1, 5) r(k)),
        g AS (SELECT word, k, substr(whole, i, k) AS gram, count(*) AS times FROM s, range(1, 67) p(i) WHERE i <= length(whole) - k + 1 GROUP BY ALL),
        n AS (SELECT lang, 0 AS k, word AS gram, n FROM c JOIN l USING (lang) UNION ALL SELECT lang, k, gram, sum(n * times) FROM c JOIN l USING (lang) JOIN g USING (word) GROUP BY ALL),
        h AS (SELECT lang, k, n, many, sum(many) OVER (PARTITION BY lang, k ORDER BY n DESC) AS kept FROM (SELECT lang, k, n, count(*) AS many FROM n GROUP BY ALL)),
        t AS (SELECT lang, k, min(n) FILTER (kept <= (SELECT most FROM m)) AS least, sum(n * many) AS total FROM h GROUP BY ALL),
        u AS (SELECT k, CAST(round(-log10(0.5 / max(total)) * 1000000) AS BIGINT) AS unseen FROM t GROUP BY k),
        e AS (SELECT lang, k, gram, CAST(round(-log10(CAST(n AS DOUBLE) / total) * 1000000) AS BIGINT) AS cost FROM n JOIN t USING (lang, k) WHERE n >= least),
        b AS (SELECT k, gram, l.lang, coalesce(e.cost, u.unseen) AS cost FROM (SELECT DISTINCT k, gram FROM e) JOIN u USING (k) CROSS JOIN l LEFT JOIN e USING (k, gram, lang)),
        w AS (SELECT word, lang, cost FROM (SELECT DISTINCT word FROM a) JOIN b ON b.k = 0 AND b.gram = word),
        o AS (SELECT word, k, lang, CAST(sum(cost * times) // sum(times) AS BIGINT) AS cost FROM g JOIN b USING (k, gram) WHERE word NOT IN (SELECT word FROM w) GROUP BY ALL),
        v AS (SELECT * FROM w UNION ALL SELECT word, lang, arg_max(cost, k) FROM o GROUP BY ALL),
        x AS (SELECT a.rid, l.lang, l.size, sum(a.n * coalesce(v.cost, u.unseen)) AS cost, sum(a.n) AS words FROM a CROSS JOIN l JOIN u ON u.k = 0 LEFT JOIN v ON v.word = a.word AND v.lang = l.lang GROUP BY ALL),
        y AS (SELECT rid, arg_min(lang, (cost, -size, lang)) AS lang_pred, min(cost) AS least, any_value(words) AS words FROM x GROUP BY rid),
        z AS (SELECT rid, lang_pred, round(1 / sum(pow(10.0::DOUBLE, CAST(least - cost AS DOUBLE) / (CAST(y.words AS DOUBLE) * 1000000))), 9) AS score FROM x JOIN y USING (rid) GROUP BY ALL)
        SELECT doc_id, held_out, coalesce(lang_pred, 'und') AS lang_pred, coalesce(score, 0.0::DOUBLE) AS score FROM d LEFT JOIN z USING (rid)
    """,
    "op12_spelling": f"""
        WITH RECURSIVE {CRC_TABLE},
        r AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents) WHERE length(run) >= 7 GROUP BY ALL),
        h AS (SELECT run, n, {_crc32("(CAST(doc_id AS VARCHAR) || ':' || run)")} AS h FROM r, crc),
        d AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
        w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM d WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
        x AS (SELECT word, i, left(word, i - 1) || substr(word, i + 1) AS cut FROM w, range(1, 10000) g(i) WHERE i <= length(word)),
        p AS (SELECT a.word, b.word AS near FROM x a JOIN x b ON a.i = b.i AND a.cut = b.cut AND a.word <> b.word UNION SELECT x.word, w.word FROM x JOIN w ON x.cut = w.word UNION SELECT w.word, x.word FROM x JOIN w ON x.cut = w.word),
        b AS (SELECT p.word, count(*) AS n_near, arg_min(p.near, (-w.n, p.near)) AS near, max(w.n) AS near_n FROM p JOIN w ON w.word = p.near GROUP BY p.word),
        f AS (SELECT w.word, CASE WHEN near_n >= 10 * w.n THEN near END AS form, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * w.n THEN near_n END AS form_n FROM w LEFT JOIN b USING (word)),
        o AS (SELECT word, word AS upto, 0 AS step FROM f UNION ALL SELECT o.word, f.form, o.step + 1 FROM o JOIN f ON f.word = o.upto WHERE f.form IS NOT NULL)
        SELECT word, form, root, n, n_near, form_n FROM f JOIN (SELECT word, arg_max(upto, step) AS root FROM o GROUP BY word) USING (word)
    """,
    "op13_merkle_manifest": _merkle_sql(),
}
