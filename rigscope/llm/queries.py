"""The llm queries: thin contracts over the operators, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rigscope.llm import bpe, conversations, decontaminate, jaccard, langid, licenses, packing, periods, quality, sharding, token_counts, topk, toxicity
from rigscope.llm.common import fold, table


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.token_counts(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))
    return token_counts.with_limit(counts, 1024)


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=5, every=50, scale=256)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.predict(docs, langid.fit(docs, out_of=4, held=2))
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), label="toxic", out_of=3, held=1)
    out = toxicity.score(docs, model)
    return out.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.templates(spark), least=0.6)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents"), shards=24, vnodes=64)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home_shard")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), label="quality", out_of=5, held=0)
    out = quality.score(docs, model)
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=13, percent=5)
    digest = F.sha2(F.concat_ws(",", "item_ids"), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), closing_id=1, window=2048)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source", "padded_length")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations.damaged(table(spark, sf_dir, "conversations"))
    out = conversations.digested(conversations.repair(rows, copies="copies"))
    return out.select("conv_id", "report.*", "repaired_sha256")


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    out = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN), ranks)
    ids = F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periods.collapse(periods.looped(table(spark, sf_dir, "documents")), least=6, times=4).withColumn("top", periods.greatest(F.col("runs")))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))))
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "top.start",
        "top.length",
        "top.period",
        F.floor(1000 * F.col("top.length") / F.col("top.period")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_topk_search": op2_topk_search,
        "op3_jaccard_join": op3_jaccard_join,
        "op4_language_id": op4_language_id,
        "op5_toxicity": op5_toxicity,
        "op6_license_scan": op6_license_scan,
        "op7_sharding": op7_sharding,
        "op8_quality": op8_quality,
        "op9_decontaminate": op9_decontaminate,
        "op10_packing": op10_packing,
        "op11_conversation_repair": op11_conversation_repair,
        "op12_byte_bpe": op12_byte_bpe,
        "op13_periods": op13_periods,
    }


ORACLE_SQL = {
    "op3_jaccard_join": r"""
        WITH RECURSIVE d AS (
          SELECT row_number() OVER () AS r, doc_id,
                 regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
          FROM documents
        ), s AS MATERIALIZED (
          SELECT DISTINCT r, hash(sh) AS h, sh FROM (
            SELECT r, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS sh FROM d WHERE len(w) > 0
          )
        ), n AS MATERIALIZED (SELECT r, count(*) AS n FROM s GROUP BY r),
        p AS MATERIALIZED (SELECT a.r AS x, b.r AS y, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.sh = b.sh AND a.r < b.r GROUP BY a.r, b.r),
        l AS MATERIALIZED (
          SELECT x, y FROM (SELECT x, y FROM p JOIN n u ON u.r = x JOIN n v ON v.r = y WHERE 100 * c >= 75 * (u.n + v.n - c))
        ), e AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
        reach AS (SELECT r AS a, r AS b FROM d UNION SELECT a, y FROM reach JOIN e ON b = x),
        c AS (SELECT a AS r, min(doc_id) AS component_id FROM reach JOIN d ON b = d.r GROUP BY a),
        k AS (SELECT x AS r, count(*) AS n_links FROM e GROUP BY x)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, coalesce(n_links, 0) AS n_links
        FROM d JOIN c USING (r) LEFT JOIN n USING (r) LEFT JOIN k USING (r)
    """,
    "op2_topk_search": """
        WITH v AS (
          SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
          FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
        ), s AS (
          SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        WHERE rank <= 5
    """,
    "op9_decontaminate": r"""
        WITH d AS (
          SELECT row_number() OVER () AS r, doc_id,
                 regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
          FROM documents
        ), b AS (
          SELECT CAST(item_id AS VARCHAR) AS item_id,
                 regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
          FROM benchmark WHERE item_id IS NOT NULL
        ), win AS (
          SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(list_slice(w, s + 1, s + least(len(w), 13)), ' ') AS k
          FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 13, 0) + 1)) AS s FROM b WHERE len(w) > 0)
        ), sizes AS (SELECT DISTINCT n FROM win),
        pos AS (
          SELECT r, s, n, array_to_string(list_slice(w, s + 1, s + n), ' ') AS k
          FROM (SELECT r, w, n, unnest(range(0, len(w) - n + 1)) AS s FROM d, sizes WHERE len(w) >= n)
        ), hit AS (
          SELECT r, s, pos.n, item_id FROM pos JOIN win ON pos.n = win.n AND pos.k = win.k
        ), h AS (
          SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM hit) GROUP BY r
        ), i AS (
          SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r
        )
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN h USING (r) LEFT JOIN i USING (r)
    """,
    "op11_conversation_repair": r"""
        WITH RECURSIVE crc AS (
          SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)
        ), h AS (
          SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                 xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)),
                                             lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) % 20 AS h
          FROM conversations, crc
        ), d AS (
          SELECT conv_id, turn, CASE h WHEN 4 THEN 'user' ELSE role END AS role,
                 CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
          FROM h
        ), o AS (
          SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS z FROM d
        ), f AS MATERIALIZED (
          SELECT *, left(role, 1) AS c, CASE WHEN z = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN z NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
                 lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS b
          FROM o
        ), best AS (
          SELECT conv_id, 0 AS i, {'c': 0, 'a': '', 't': ''} AS p0, NULL::STRUCT(c INTEGER, a VARCHAR, t VARCHAR) AS ps, NULL::STRUCT(c INTEGER, a VARCHAR, t VARCHAR) AS pu, NULL::STRUCT(c INTEGER, a VARCHAR, t VARCHAR) AS pa
          FROM (SELECT DISTINCT conv_id FROM conversations)
          UNION ALL
          SELECT conv_id, i,
            CASE WHEN p0 IS NULL THEN NULL ELSE {'c': p0.c + 3, 'a': p0.a || 'D', 't': p0.t} END,
            list_min(list_filter([CASE WHEN ps IS NOT NULL THEN {'c': ps.c + 3, 'a': ps.a || 'D', 't': ps.t} END, CASE WHEN keep AND c = 's' AND p0 IS NOT NULL THEN {'c': p0.c + x, 'a': p0.a || 'K', 't': p0.t || line} END], lambda v: v IS NOT NULL)),
            list_min(list_filter([CASE WHEN qu IS NOT NULL THEN {'c': qu.c + 3, 'a': qu.a || 'D', 't': qu.t} END,
              CASE WHEN keep AND c = 'u' AND p0 IS NOT NULL THEN {'c': p0.c + x, 'a': p0.a || 'K', 't': p0.t || line} END, CASE WHEN keep AND p0 IS NOT NULL THEN {'c': p0.c + 2 + x, 'a': p0.a || 'R', 't': p0.t || nl || 'user:' || text} END,
              CASE WHEN keep AND c = 'u' AND ps IS NOT NULL THEN {'c': ps.c + x, 'a': ps.a || 'K', 't': ps.t || line} END, CASE WHEN keep AND ps IS NOT NULL THEN {'c': ps.c + 2 + x, 'a': ps.a || 'R', 't': ps.t || nl || 'user:' || text} END,
              CASE WHEN keep AND c = 'u' AND qa IS NOT NULL THEN {'c': qa.c + x, 'a': qa.a || 'K', 't': qa.t || line} END, CASE WHEN keep AND qa IS NOT NULL THEN {'c': qa.c + 2 + x, 'a': qa.a || 'R', 't': qa.t || nl || 'user:' || text} END], lambda v: v IS NOT NULL)),
            list_min(list_filter([CASE WHEN qa IS NOT NULL THEN {'c': qa.c + 3, 'a': qa.a || 'D', 't': qa.t} END,
              CASE WHEN keep AND c = 'a' AND qu IS NOT NULL THEN {'c': qu.c + x, 'a': qu.a || 'K', 't': qu.t || line} END, CASE WHEN keep AND qu IS NOT NULL THEN {'c': qu.c + 2 + x, 'a': qu.a || 'R', 't': qu.t || nl || 'assistant:' || text} END], lambda v: v IS NOT NULL))
          FROM (
            SELECT *, list_min(list_filter([pa, CASE WHEN qu IS NOT NULL THEN {'c': qu.c + 2, 'a': qu.a || 'I', 't': qu.t || nl || 'assistant:'} END], lambda v: v IS NOT NULL)) AS qa
            FROM (
              SELECT s.conv_id, f.i, p0, ps, pu, pa, f.c, f.text, chr(10) AS nl, chr(10) || f.role || ':' || f.text AS line, coalesce(fault, '') NOT IN ('blank', 'duplicate') AS keep, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS x,
                list_min(list_filter([pu, CASE WHEN p0 IS NOT NULL THEN {'c': p0.c + 2, 'a': p0.a || 'I', 't': p0.t || chr(10) || 'user:'} END, CASE WHEN ps IS NOT NULL THEN {'c': ps.c + 2, 'a': ps.a || 'I', 't': ps.t || chr(10) || 'user:'} END, CASE WHEN pa IS NOT NULL THEN {'c': pa.c + 2, 'a': pa.a || 'I', 't': pa.t || chr(10) || 'user:'} END], lambda v: v IS NOT NULL)) AS qu
              FROM best s JOIN f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.i = s.i + 1
            )
          )
        ), done AS (
          SELECT conv_id, list_min(list_filter([p0, pa, CASE WHEN pu IS NOT NULL THEN {'c': pu.c + 2, 'a': pu.a || 'I', 't': pu.t || chr(10) || 'assistant:'} END, CASE WHEN ps IS NOT NULL THEN {'c': ps.c + 4, 'a': ps.a || 'II', 't': ps.t || chr(10) || 'user:' || chr(10) || 'assistant:'} END], lambda v: v IS NOT NULL)) AS r
          FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) AS k FROM best) WHERE k = 1
        ), n AS (
          SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                 count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (b IS NOT NULL AND b || c NOT IN ('su', 'ua', 'au')) AS illegal
          FROM f GROUP BY conv_id
        )
        SELECT done.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
               CAST(r.c AS BIGINT) AS cost, r.a AS audit, sha256(substr(r.t, 2)) AS repaired_sha256
        FROM done LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM done.conv_id
    """,
}
