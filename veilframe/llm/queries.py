"""The queries op1 to op13 and pipeline, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import hpylm, images, merkle, mixing, neighbours, packing, passages, pieces, simhash, sstable, toxicity, trie, warc
from veilframe.llm.common import new_path, save, table

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS HUGEINT) AS source_size, count(*) AS n FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
a AS (SELECT *, sum(source_size) OVER () AS words, sum(weight) OVER () AS weights,
 coalesce(sum(source_size * 3) OVER (ORDER BY source_size * 3 / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held_before,
 coalesce(sum(weight) OVER (ORDER BY source_size * 3 / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weight_before FROM w),
h AS (SELECT *, source_size * 3 * (weights - weight_before) <= weight * (words - held_before) AS held FROM a),
l AS (SELECT *, sum(CASE WHEN held THEN source_size * 3 ELSE 0 END) OVER () AS held_words, sum(CASE WHEN held THEN weight ELSE 0 END) OVER () AS held_weight FROM h),
t AS (SELECT source, n, CAST(source_size AS BIGINT) AS source_size, held,
 CASE WHEN held THEN CAST(source_size * 3 AS DOUBLE) ELSE CAST(weight * (words - held_words) AS DOUBLE) / CAST(weights - held_weight AS DOUBLE) END AS target FROM l),
p AS (SELECT source, source_size, target, least(65536, (n + 4095) // 4096) AS cells,
 CASE WHEN source_size = 0 THEN 0 WHEN held THEN 3 * 16777216 ELSE least(CAST(floor(target / source_size * 16777216) AS BIGINT), 3 * 16777216) END AS step,
 CAST('0x' || substr(md5('mix-1:' || coalesce('s' || source, 'null')), 1, 6) AS BIGINT) AS u FROM t),
r AS (SELECT d.*, p.source_size, p.target, p.step, p.u,
 row_number() OVER (PARTITION BY d.source ORDER BY CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) % cells, size, doc_id NULLS FIRST) AS k
 FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, size * (((k * step + u) >> 24) - (((k - 1) * step + u) >> 24)) AS taken FROM r
"""


@query("op4_mix_sources", MIX_SQL)
def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, mixed to 5:2:1 by source."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op7_simhash")
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints of all documents and the components of those within two bits."""
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learnt from the labels outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    worst = F.array_sort("offending", lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).otherwise(a["start"] - b["start"]))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("offending").alias("n_offending"), F.get(worst, F.lit(0))["start"].alias("worst_start"), F.get(worst, F.lit(0))["end"].alias("worst_end"))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op3_pack_sequences")
def op3_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens; the ids stay in the saved pieces, a digest of them is returned."""
    parts = save(packing.pieces(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json")), "pieces")
    return packing.pack(parts.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


@query("op6_sstable")
def op6_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents written as sorted-string-table shards and read back."""
    path = new_path(spark, "shards")
    sstable.write(table(spark, sf_dir, "documents"), path, tokenizer=tokenizer_path("word_bpe_49k.json"), kind="words", end_id=1)
    return sstable.positions(spark, path).withColumnRenamed("key", "doc_id")


WARC_SQL = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_page FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first_page <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN first_page <> page_id THEN first_page END AS refers_to FROM f
"""


@query("op10_warc", WARC_SQL)
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages archived in dictionary-compressed WARC files and read back."""
    path = new_path(spark, "archive")
    warc.write(table(spark, sf_dir, "pages"), path)
    stored = warc.read(spark, path)
    intact = F.when(F.col("payload").isNull() | (F.sha2("payload", 256) == F.col("payload_digest")), F.col("payload_digest"))
    return stored.select("page_id", "payload_bytes", intact.alias("payload_digest"), "record_type", "refers_to")


@query("op5_passages")
def op5_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document has as well."""
    found = passages.repeated_passages(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "start_word", "end_word", F.col("of_id").alias("of_doc_id"), "of_start", "of_end", "similarity")


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline, one after another, over all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


@query("op1_curve_neighbours")
def op1_curve_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found to every twentieth vector, by inner product."""
    return neighbours.search(table(spark, sf_dir, "embeddings"))


@query("op2_hpylm")
def op2_hpylm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all documents under the Pitman-Yor model learnt from nine tenths of them."""
    return hpylm.score(table(spark, sf_dir, "documents"))


@query("op8_image_copies")
def op8_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies among the pictures of all embeddings (64 values, an 8 x 8 picture enlarged to 64 x 64)."""
    return images.copies(images.pictures(table(spark, sf_dir, "embeddings")))


def crc_sql(text: str) -> str:
    """CRC-32 of a text of plain ASCII, bit by bit."""
    step = f"CASE WHEN i % 8 = 0 THEN xor(c, CAST(ascii(substr({text}, i // 8 + 1, 1)) AS BIGINT)) ELSE c END"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), range(CAST(8 * length({text}) AS BIGINT))), lambda c, i: xor(({step}) >> 1, (({step}) & 1) * 3988292384)), CAST(4294967295 AS BIGINT))"


def merkle_sql(levels: int = 5, top_levels: int = 4) -> str:
    """Runs of 16, level by level, as far as so many levels go (16 to that power of documents a source, and of sources)."""
    hashed = lambda text: "sha256(" + " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    lowered = f"translate(text, '{merkle.UPPER}', '{merkle.LOWER}')"
    steps = [
        f"d AS (SELECT doc_id, source, {hashed('text')} AS leaf, CASE WHEN {crc_sql('CAST(doc_id AS VARCHAR)')} % 5 = 0 THEN {hashed(lowered)} ELSE {hashed('text')} END AS f FROM documents)",
        "s0 AS (SELECT *, leaf AS h, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM d)",
    ]
    around = "coalesce(string_agg(h, '') OVER (PARTITION BY {by}i // 16 ORDER BY i ROWS BETWEEN {rows}), '')"
    lo, hi = (lambda by: around.format(by=by, rows="UNBOUNDED PRECEDING AND 1 PRECEDING")), (lambda by: around.format(by=by, rows="1 FOLLOWING AND UNBOUNDED FOLLOWING"))
    for name, by, depth in (("s", "source, ", levels), ("t", "", top_levels)):
        for k in range(depth):
            steps.append(f"{name}{k}_run AS (SELECT {by}i, n, h, {lo(by)} AS lo, {hi(by)} AS hi FROM {name}{k})")
            steps.append(f"{name}{k + 1} AS (SELECT {by}i // 16 AS i, any_value((n + 15) // 16) AS n, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM {name}{k} GROUP BY {by}i // 16)")
        if name == "s":
            steps.append(f"t0 AS (SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM s{depth})")
    joins, fold, proof = "", "s0.f", []
    for name, own, depth in (("s", "s0", levels), ("t", "t0", top_levels)):
        for k in range(depth):
            r = f"{name}{k}_run"
            same = f"{r}.source IS NOT DISTINCT FROM s0.source AND " if name == "s" else ""
            joins += f" JOIN {r} ON {same}{r}.i = {own}.i // {16**k}"
            fold = f"CASE WHEN {r}.n = 1 THEN {fold} ELSE sha256({r}.lo || {fold} || {r}.hi) END"
            proof += [f"{r}.lo", f"{r}.hi"]
        if name == "s":
            joins += " JOIN t0 ON t0.source IS NOT DISTINCT FROM s0.source"
    root = f"(SELECT h FROM t{top_levels})"
    depth = " + ".join(f"CAST({name}{k}_run.n > 1 AS INT)" for name, depth in (("s", levels), ("t", top_levels)) for k in range(depth))
    steps.append(f"p AS (SELECT doc_id, leaf, t0.h AS subroot, {root} AS root, sha256({' || '.join(proof)}) AS proof_sha256, {fold} AS folded_root, CAST({depth} AS INT) AS depth FROM s0{joins})")
    return f"WITH {', '.join(steps)} SELECT *, folded_root = root AS verified FROM p"


@query("op11_merkle_manifest", merkle_sql())
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a leaf of the manifest, its proof, and the root that its text leads to where a fifth are changed."""
    return merkle.verified(table(spark, sf_dir, "documents"))


TRIE_SQL = rf"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos FROM conversations WHERE conv_id IS NOT NULL),
x AS (SELECT conv_id, pos, sha256(strlen(role) || ':' || role || text) AS label, CAST(len(regexp_extract_all(text, '[^ 	-
]+')) AS BIGINT) AS words FROM t),
c AS (SELECT DISTINCT conv_id, conv_id - conv_id % 20 AS head_id, {crc_sql("CAST(conv_id AS VARCHAR)")} % 4 AS h FROM x),
r AS (SELECT c.conv_id, x.pos, x.label, x.words, 0 AS part FROM c JOIN x ON x.conv_id = c.head_id AND x.pos <= c.h
 UNION ALL SELECT c.conv_id, x.pos, x.label, x.words, 1 FROM c JOIN x ON x.conv_id = c.conv_id AND x.pos > c.h),
p AS (SELECT conv_id, words, row_number() OVER w AS depth, string_agg(label, '') OVER w AS prefix FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos ROWS UNBOUNDED PRECEDING)),
a AS (SELECT conv_id, depth, prefix, words FROM p UNION ALL SELECT conv_id, 0, '', 0 FROM c),
l AS (SELECT conv_id, max(depth) AS ends_at FROM a GROUP BY conv_id),
n AS (SELECT a.prefix, any_value(a.depth) AS depth, any_value(a.words) AS words, min(a.conv_id) AS conv_id, count(*) AS n_convs,
 sha256(coalesce(string_agg(CAST(a.conv_id AS VARCHAR), ',' ORDER BY a.conv_id) FILTER (WHERE a.depth = l.ends_at), '')) AS ends_sha256 FROM a JOIN l ON a.conv_id = l.conv_id GROUP BY a.prefix),
k AS (SELECT left(prefix, 64 * (depth - 1)) AS prefix, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
f AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children, (n.n_convs - 1) * n.words AS own FROM n LEFT JOIN k ON n.prefix = k.prefix),
u AS (SELECT left(prefix, 64 * d) AS prefix, own, n_children FROM (SELECT *, unnest(range(depth + 1)) AS d FROM f)),
s AS (SELECT prefix, CAST(sum(own) AS BIGINT) AS saved_tokens, CAST(count(*) FILTER (WHERE n_children = 0) AS BIGINT) AS n_leaves FROM u GROUP BY prefix)
SELECT f.conv_id, f.depth, CASE WHEN f.depth > 0 THEN o.conv_id END AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens, f.ends_sha256
FROM f JOIN s ON f.prefix = s.prefix LEFT JOIN n o ON o.prefix = left(f.prefix, 64 * (f.depth - 1)) AND f.depth > 0
"""


@query("op12_prefix_trie", TRIE_SQL)
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, rebuilt on shared beginnings."""
    return trie.nodes(table(spark, sf_dir, "conversations")).drop("a", "b")


@query("op13_sentencepiece")
def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents by merges of the piece vocabulary, digests of them and of the text they decode to, and whether the library
    has the same ids, asked about every text."""
    got = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path("piece_bpe_32k.model"), decoded="decoded", every=1)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return got.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "agreed")
