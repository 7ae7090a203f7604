"""One query per operator: thin callables that derive digest columns from the operators' results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.llm import decontaminate, embeddings, manifest, ngram_join, packing, quality, search, secrets, token_files, toxicity, unigram, warc
from tamarack.llm.labelled import held_out
from tamarack.llm.workspace import Workspace


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    return quality.scored(spark, docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(spark, docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(spark, docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scanned(spark, table(spark, sf_dir, "documents"))

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def number(kind: str) -> Column:
        return F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("secret_spans", lambda s: s["kind"] != "markov")
    return found.select("doc_id", number("assign"), number("access"), number("hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("secret_spans")).alias("spans"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Workspace(spark, "op5").path("files")
    token_files.write(spark, table(spark, sf_dir, "documents"), path)
    return token_files.read(spark, path, with_ids=False)


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link(spark, table(spark, sf_dir, "documents"))


def op6_ngram_link_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of ``op6_ngram_jaccard_join`` and the number of each document's links."""
    return ngram_join.link_counts(spark, table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Workspace(spark, "op7").path("archives")
    warc.write(spark, table(spark, sf_dir, "pages"), path)
    return warc.read(spark, path, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of each document and whether decoding them gives its text again."""
    return unigram.round_tripped(spark, table(spark, sf_dir, "documents")).select("doc_id", "n_pieces", "ids", "round_trip")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.counted(spark, table(spark, sf_dir, "documents")).select("doc_id", "n_tokens")


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(spark, table(spark, sf_dir, "embeddings"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's proof; some claims have one character more than the document that the manifest was made of."""
    path, docs = Workspace(spark, "op11").path("manifest"), table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    plain = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    changed = [F.col("n_chars") + 1 if k == 3 else c for k, c in enumerate(plain)]
    manifest.write(spark, docs, path, claim=F.when(tampered, manifest.leaf_of(*changed)).otherwise(manifest.leaf_of(*plain)))
    return manifest.verified(spark, path).withColumnRenamed("key", "doc_id")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, docs = Workspace(spark, "op12").path("index"), table(spark, sf_dir, "documents")
    search.index(spark, docs, path)
    return search.search(spark, docs, table(spark, sf_dir, "benchmark"), path)


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_benchmark_decontamination,
        op2_quality_classifier,
        op3_toxicity,
        op4_secret_scans,
        op5_token_files,
        op6_ngram_jaccard_join,
        op6_ngram_link_counts,
        op7_warc,
        op8_sentencepiece,
        op9_token_counts,
        op10_embedding_near_dedup,
        op11_merkle_manifest,
        op12_ranked_search,
        op13_packing,
    )
}

ORACLE_SQL = {
    "op7_warc": """
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
        ), f AS (
            SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p
        ), d AS (
            SELECT *, (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (('0x' || substr(h, 1 + 5 * (i // 4), 5))::BIGINT >> (5 * (3 - i % 4)) & 31)::INT, 1), '' ORDER BY i) FROM range(32) r(i)) AS payload_digest FROM f
        )
        SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
            CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
        FROM d
    """,
    "op10_embedding_near_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), l AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a, v b WHERE a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9
        ), r AS (
            SELECT vec_id, vec_id AS other FROM embeddings
            UNION
            SELECT r.vec_id, l.b FROM r JOIN l ON r.other = l.a
        ), c AS (SELECT vec_id, min(other) AS component_id FROM r GROUP BY vec_id),
        n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
        SELECT c.vec_id, coalesce(n.n_links, 0) AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN n ON n.a = c.vec_id
    """,
    "op6_ngram_jaccard_join": """
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
        ), s AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w
        ), u AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
        k AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS i FROM u a JOIN u b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM k WHERE 100 * i >= 75 * (na + nb - i)),
        r AS (
            SELECT doc_id, doc_id AS other FROM documents
            UNION
            SELECT r.doc_id, l.b FROM r JOIN l ON r.other = l.a
        )
        SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, c.component_id
        FROM s JOIN (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)
    """,
}

ORACLE_SQL["op6_ngram_link_counts"] = ORACLE_SQL["op6_ngram_jaccard_join"].replace(
    "n_shingles, c.component_id\n        FROM s", "n_shingles, c.component_id, coalesce(n.n_links, 0) AS n_links\n        FROM s LEFT JOIN (SELECT a AS doc_id, count(*) AS n_links FROM l GROUP BY a) n USING (doc_id)"
)


def _leaf_sql(n_chars: str) -> str:
    values = ("doc_id", "source", "lang", n_chars, "text")
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode(({v})::VARCHAR))::VARCHAR || ':' || ({v})::VARCHAR, '-')" for v in values) + ")"


_CRC32 = """xor(list_reduce(list_transform(range(1, len(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT),
    lambda crc, x: list_reduce(range(8), lambda c, k: xor(c >> 1, (c & 1) * 3988292384), xor(crc, x)), 4294967295), 4294967295)"""


def _tree_sql(name: str, group: str) -> str:
    """All levels above the leaves of ``name(group, p, h)``."""
    return f"""SELECT {group}, 0 AS level, p, h, count(*) OVER (PARTITION BY {group}) AS n FROM {name}
            UNION ALL SELECT {group}, any_value(level) + 1, p // 2, sha256(string_agg(h, '' ORDER BY p)), any_value((n + 1) // 2) FROM {name}_tree WHERE n > 1 GROUP BY {group}, p // 2"""


def _fold_sql(name: str, tree: str, start: str) -> str:
    """Claims carried up a tree: ``doc_id, g, level, p, n, h, proof``."""
    return f"""{start}
            UNION ALL SELECT f.doc_id, f.g, f.level + 1, f.p // 2, (f.n + 1) // 2, sha256(CASE WHEN s.h IS NULL THEN f.h WHEN s.p < f.p THEN s.h || f.h ELSE f.h || s.h END), f.proof || coalesce(s.h, '')
            FROM {name} f LEFT JOIN {tree} s ON s.g IS NOT DISTINCT FROM f.g AND s.level = f.level AND s.p = xor(f.p, 1) WHERE f.n > 1"""


ORACLE_SQL["op11_merkle_manifest"] = f"""
        WITH RECURSIVE d AS (
            SELECT doc_id, lang AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS p, {_leaf_sql("n_chars")} AS h, {_leaf_sql(f"n_chars + ({_CRC32} % 7 = 0)::INT")} AS claim FROM documents
        ), d_tree AS ({_tree_sql("d", "g")}),
        r AS (SELECT 0 AS g, g AS lang, h, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS p FROM d_tree WHERE n = 1),
        r_tree AS ({_tree_sql("r", "g")}),
        low AS ({_fold_sql("low", "d_tree", "SELECT d.doc_id, d.g, 0 AS level, d.p, t.n, d.claim AS h, '' AS proof FROM d JOIN d_tree t ON t.g IS NOT DISTINCT FROM d.g AND t.level = 0 AND t.p = d.p")}),
        high AS ({_fold_sql("high", "r_tree", "SELECT low.doc_id, 0 AS g, 0 AS level, r.p, t.n, low.h, low.proof FROM low JOIN r ON r.lang IS NOT DISTINCT FROM low.g JOIN r_tree t ON t.level = 0 AND t.p = r.p WHERE low.n = 1")})
        SELECT d.doc_id, d.h AS leaf, r.h AS subroot, w.h AS root, sha256(f.proof) AS proof_sha256, f.h AS folded_root, f.h = w.h AS verified
        FROM d JOIN r ON r.lang IS NOT DISTINCT FROM d.g JOIN high f ON f.doc_id = d.doc_id AND f.n = 1, (SELECT h FROM r_tree WHERE n = 1) w
    """

_TERMS = "list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
ORACLE_SQL["op12_ranked_search"] = f"""
        WITH t AS (SELECT doc_id, {_TERMS} AS w FROM documents),
        c AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM t) GROUP BY ALL),
        n AS (SELECT doc_id, len(w)::BIGINT AS n FROM t WHERE len(w) > 0),
        s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS l FROM n),
        d AS (SELECT term, count(*) AS df FROM c GROUP BY term),
        q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
        r AS (
            SELECT item_id, doc_id, sum(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // l))))::BIGINT AS score
            FROM q JOIN c USING (term) JOIN d USING (term) JOIN n USING (doc_id), s GROUP BY ALL
        )
        SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM r WHERE score > 0) WHERE rank <= 50
    """
