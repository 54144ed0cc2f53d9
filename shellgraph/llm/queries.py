"""The queries ``opN_<name>`` over the driver's tables, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import chat, decontam, edit_embedding, jump_hash, langid, line_dedup, link_graph, merkle, minhash, mixing, pii, token_align, warc

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_edit_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, its edited text and the next document, and its class of near copies."""
    return edit_embedding.with_classes(_table(spark, sf_dir, "documents"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations as chains of replies, and one that tries to forge marks; digests of what
    is read back from the formatted text."""
    forged = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(forged).alias("text"))
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    out = chat.format_paths(chat.thread(rows), per_tree=1)
    back, loss = chat.read_back(F.col("formatted")), chat.loss_text(F.col("formatted"), F.col("loss_spans"))
    out = out.select(F.col("tree.conv_id").alias("conv_id"), "formatted", back.alias("turns"), loss.alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op3_bm25_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of every document against every benchmark item: a row for each leak."""
    return decontam.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC archives into the shared folder and read back. Ranges of 16 MB, so
    that even small tables are written by several tasks."""
    root = C.Scratch(spark).path("warc")
    warc.write(_table(spark, sf_dir, "pages"), root, warc.Layout(range_bytes=16 << 20))
    return warc.read(spark, root, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


RULES = (
    link_graph.Rule("block", "com", "/en/"),
    link_graph.Rule("allow", "example.com", "/en/7"),
    link_graph.Rule("allow", "net", "/de/"),
    link_graph.Rule("block", "example.net", "/de/8"),
    link_graph.Rule("block", "org", "/es/"),
)


def op5_link_graph_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules first, then trust and distrust over all links of all pages."""
    return link_graph.judge(_table(spark, sf_dir, "pages"), RULES)


def op6_jump_hash_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen shards, and one more."""
    return jump_hash.assign(_table(spark, sf_dir, "documents"), 16)


def op7_block_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights 3, 1, 2 over the sources, 150 % of all words, at most twice a source."""
    return mixing.taken(_table(spark, sf_dir, "documents"), mixing.Mix(weights=(3, 1, 2), share=1.5, cap=2.0))


def op8_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its private values replaced. The key is a fixed one for reproducible
    results; a real run passes its own."""
    return pii.pseudonymise(_table(spark, sf_dir, "documents").select("doc_id", "text"), b"fixed demonstration key")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from the documents outside the held-out quarter, predicts all."""
    docs = _table(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = langid.train(docs.where(~held).select("text", "lang"))
    out = langid.predict(docs.select("doc_id", "text", held.alias("held_out")), model)
    return out.select("doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected")


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles at 0.85, every document."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), minhash.MinHash(shingle=3, percent=85))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of ten documents or more, dropped from all documents."""
    out = line_dedup.drop_common(_table(spark, sf_dir, "documents").select("doc_id", "text"), line_dedup.Lines(min_docs=10, min_chars=1))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens of both vocabularies, grouped and linked."""
    return token_align.align(_table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf and proof; those whose id's checksum 5 divides are folded from a tampered text."""
    changed = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return merkle.verify(_table(spark, sf_dir, "documents"), changed)


def queries() -> dict[str, Query]:
    return {
        "op1_edit_embedding": op1_edit_embedding,
        "op2_chat_format": op2_chat_format,
        "op3_bm25_decontamination": op3_bm25_decontamination,
        "op4_warc_round_trip": op4_warc_round_trip,
        "op5_link_graph_filter": op5_link_graph_filter,
        "op6_jump_hash_shards": op6_jump_hash_shards,
        "op7_block_mixture": op7_block_mixture,
        "op8_feistel_pseudonyms": op8_feistel_pseudonyms,
        "op9_language_id": op9_language_id,
        "op10_minhash_near_dedup": op10_minhash_near_dedup,
        "op11_line_dedup": op11_line_dedup,
        "op12_token_alignment": op12_token_alignment,
        "op13_merkle_manifest": op13_merkle_manifest,
    }


_WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _tree_sql(name: str, rows: str, group: str, levels: int) -> str:
    """CTEs over ``rows`` (group, i, h): the levels of its trees, and ``name`` (group, i, root, steps) with each leaf's siblings
    left and right, a struct a level."""
    out = [f"{name}0 AS (SELECT {group}, i, h FROM {rows})"]
    for k in range(levels):
        # a tree that is one node stays as it is
        out.append(f"{name}{k + 1} AS (SELECT {group}, i // 16 AS i, CASE WHEN any_value(m) = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM (SELECT *, count(*) OVER (PARTITION BY {group}) AS m FROM {name}{k}) GROUP BY {group}, i // 16)")
        out.append(f"{name}s{k} AS (SELECT a.{group}, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r, max(a.m) AS m FROM (SELECT *, count(*) OVER (PARTITION BY {group}) AS m FROM {name}{k}) a JOIN {name}{k} b ON a.{group} = b.{group} AND a.i // 16 = b.i // 16 GROUP BY a.{group}, a.i)")
    joins = " ".join(f"JOIN {name}s{k} s{k} ON s{k}.{group} = z.{group} AND s{k}.i = z.i // {16**k}" for k in range(levels))
    steps = "list_filter([" + ", ".join(f"{{'l': s{k}.l, 'r': s{k}.r, 'm': s{k}.m}}" for k in range(levels)) + "], lambda s: s.m > 1)"
    out.append(f"{name} AS (SELECT z.{group}, z.i, t.h AS root, {steps} AS steps FROM {name}0 z {joins} JOIN {name}{levels} t ON t.{group} = z.{group})")
    return ", ".join(out)


_CRC = "list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS UBIGINT))), lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 1, 2, 3, 4, 5, 6, 7]::UBIGINT[]), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END))"


def _merkle_sql(levels: int = 5, crown: int = 2) -> str:
    """Trees of up to 16 ** levels documents a source, and 16 ** crown sources."""
    part = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')"
    leaf = lambda text: "sha256(" + " || ".join(part(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
        WITH d AS (SELECT doc_id, coalesce('1' || source, '0') AS g, {leaf('text')} AS leaf, CASE WHEN xor({_CRC}, 4294967295::UBIGINT) % 5 = 0 THEN {leaf(low)} ELSE {leaf('text')} END AS now FROM documents),
        n AS (SELECT *, leaf AS h, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d), {_tree_sql('t', 'n', 'g', levels)},
        u AS (SELECT 0 AS o, g, root AS h, row_number() OVER (ORDER BY encode(g)) - 1 AS i FROM (SELECT DISTINCT g, root FROM t)), {_tree_sql('c', 'u', 'o', crown)},
        f AS (SELECT n.doc_id, n.leaf, n.now, t.root AS subroot, c.root, list_concat(t.steps, c.steps) AS steps FROM n JOIN t ON t.g = n.g AND t.i = n.i JOIN u ON u.g = n.g JOIN c ON c.i = u.i),
        e AS (SELECT *, list_reduce(list_prepend({{'l': '', 'r': '', 'm': 0, 'h': now}}, list_transform(steps, lambda s: {{'l': s.l, 'r': s.r, 'm': s.m, 'h': ''}})), lambda a, s: {{'l': '', 'r': '', 'm': s.m, 'h': sha256(s.l || a.h || s.r)}}).h AS folded FROM f)
        SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(steps, lambda s: s.l || s.r), '')) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM e"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_chat_format": r"""
            WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
            g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
                coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '') AS loss,
                sum(length(role) + length(text) + 17 + length(regexp_replace(role, '[^\\<\[\n]', '', 'g')) + length(regexp_replace(text, '[^\\<\[]', '', 'g'))) AS formatted
                FROM c GROUP BY conv_id)
            SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
                CAST(formatted AS BIGINT) AS formatted_chars FROM g""",
        "op4_warc_round_trip": """
            WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n, sha1(coalesce(html, '')) AS d FROM pages),
            t AS (SELECT *, max(page_id) OVER (PARTITION BY n, d) AS top FROM p)
            SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
                CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to FROM t""",
        "op10_minhash_near_dedup": f"""
            WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS ws FROM documents),
            s AS (SELECT doc_id, CASE WHEN len(ws) >= 3 THEN list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))
                WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS g FROM w),
            x AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s WHERE len(g) > 0),
            e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id
                GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
            r(d, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON r.d = e.a),
            m AS (SELECT d, min(c) AS c FROM r GROUP BY d)
            SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, m.c AS component_id, s.doc_id = m.c AS kept
            FROM s JOIN m ON s.doc_id = m.d""",
        "op11_line_dedup": """
            WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
            x AS (SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
            k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM x),
            f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10),
            m AS (SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f ON k.key = f.key)
            SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
                sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY r, doc_id""",
        "op13_merkle_manifest": _merkle_sql(),
    }
