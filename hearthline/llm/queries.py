"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, exact_dedup, interpolation, language, minhash, mixing, packing, periodic, phrases, pieces
from . import quality_rules, suffixes, toxicity


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_documents(spark, sf_dir), percent=85, words=3)


def op2_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(_documents(spark, sf_dir), ["doc_id"])


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.passage_report(_documents(spark, sf_dir))


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = language.fold("doc_id", 20)
    role = F.when(part % 5 == 1, 0).when(part == 2, 2).otherwise(1)
    return interpolation.score_texts(_documents(spark, sf_dir), role)


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix by document, in training order: what it takes of each, and when the first and last copy's turn is."""
    planned = mixing.schedule(_documents(spark, sf_dir).select("doc_id", "text", "source"))
    return mixing.in_order(planned).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("copies")).alias("taken"),
        F.get("positions", F.lit(0)).alias("first_position"),
        F.get("positions", (F.col("copies") - 1).cast("int")).alias("last_position"),
    )


def op6_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every copy that the mix takes, with its epoch and position, in training order."""
    docs = _documents(spark, sf_dir).select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "epoch", "position")


def op7_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).withColumn("held_out", language.fold("doc_id", 3) == 1)
    model = language.fit(docs.where(~F.col("held_out")))
    return language.identify(docs, model, keep=["doc_id", "held_out"])


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_report(_documents(spark, sf_dir), keep="max")


def trusted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents labelled as good."""
    return spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return quality_rules.assess(docs, trusted_ids(spark, sf_dir)).drop("text", "n_grams")


def repeated_tail(doc_id: object, n: int) -> np.ndarray | None:
    """In one document of ten the words behind a place repeat those that follow it."""
    number = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if number % 10 or not n:
        return None
    g = number // 10
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    places = np.arange(n)
    places[a:] = a + (places[a:] - a) % period
    return places


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find_runs(_documents(spark, sf_dir).select("doc_id", "text"), shown=repeated_tail)
    # Runs go by start, then period: the first of those with the largest exponent stays.
    larger = F.aggregate(
        F.slice("runs", 2, F.greatest(F.size("runs"), F.lit(1))),
        F.get("runs", F.lit(0)),
        lambda best, run: F.when(
            run["length"] * best["period"] > best["length"] * run["period"], run
        ).otherwise(best),
    )
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.withColumn("best", larger).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text").withColumn("held_out", toxicity.fold("doc_id", 4) == 2)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.fit(docs.where(~F.col("held_out")), labels)
    return toxicity.score(docs, model, keep=["doc_id", "held_out"])


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_documents(spark, sf_dir).select("doc_id", "lang", "text"))


QUERIES = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_sentence_pieces": op2_sentence_pieces,
    "op3_chat_formatting": op3_chat_formatting,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_lm_scores": op5_lm_scores,
    "op6_source_mix": op6_source_mix,
    "op6_training_order": op6_training_order,
    "op7_packed_ids": op7_packed_ids,
    "op8_language_id": op8_language_id,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_quality_rules": op10_quality_rules,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_toxicity": op12_toxicity,
    "op13_phrases": op13_phrases,
}

ORACLE = {
    "op1_minhash_dedup": r"""
        WITH RECURSIVE worded AS (
            SELECT doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ), sets AS (
            SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []
                WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS s
            FROM worded
        ), members AS (
            SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets
        ), links AS (
            SELECT a.doc_id AS u, b.doc_id AS v
            FROM members AS a JOIN members AS b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n
            HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
        ), reach AS (
            SELECT doc_id, doc_id AS component FROM documents
            UNION
            SELECT reach.doc_id, v FROM reach JOIN links ON reach.component = u
        ), named AS (
            SELECT doc_id, min(component) AS component_id FROM reach GROUP BY doc_id
        )
        SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
        FROM sets JOIN named USING (doc_id)
    """,
    "op3_chat_formatting": """
        WITH turns AS (
            SELECT DISTINCT conv_id, turn, role, text FROM conversations
        ), placed AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS place FROM turns
        ), logged AS (
            SELECT conv_id, count(*) AS n_turns,
                   list(struct_pack(r := role, t := text) ORDER BY place) AS said
            FROM placed GROUP BY conv_id
        ), kept AS (
            SELECT conv_id, n_turns FROM logged AS a
            WHERE NOT EXISTS (
                SELECT 1 FROM logged AS b
                WHERE b.said[1] = a.said[1] AND b.said[1:a.n_turns] = a.said
                  AND (b.n_turns > a.n_turns OR b.conv_id < a.conv_id)
            )
        )
        SELECT p.conv_id,
               CAST(dense_rank() OVER (PARTITION BY p.conv_id ORDER BY floor(turn / 256)) - 1 AS INTEGER) AS segment,
               any_value(n_turns) AS n_turns,
               min(place) AS first_turn,
               string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY place)
                   AS text
        FROM placed AS p JOIN kept USING (conv_id)
        GROUP BY p.conv_id, floor(turn / 256)
    """,
    "op6_source_mix": r"""
        WITH sized AS (
            SELECT doc_id, source, md5(CAST(doc_id AS VARCHAR)) AS k,
                   CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
            FROM documents
        ), sources AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
                   row_number() OVER (ORDER BY source IS NULL, source) - 1 AS turn
            FROM sized GROUP BY source
        ), caps AS (
            SELECT *, 2 * source_size AS cap, [5, 2, 1][turn % 3 + 1] AS weight FROM sources
        ), levels AS (
            SELECT *, (sum(source_size) OVER () * 150 / 100.0::DOUBLE
                       - coalesce(sum(cap) OVER (ORDER BY cap / weight, turn
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                      / sum(weight) OVER (ORDER BY cap / weight, turn
                                  ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
            FROM caps
        ), targets AS (
            SELECT source, source_size, turn,
                   least(CAST(cap AS DOUBLE),
                         coalesce(max(CASE WHEN level * weight <= cap THEN level END) OVER (), 0) * weight) AS target
            FROM levels
        ), placed AS (
            SELECT d.doc_id, d.size, t.source_size, t.target, t.turn,
                   CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS epochs,
                   coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size
                            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
            FROM sized AS d JOIN targets AS t ON d.source IS NOT DISTINCT FROM t.source
        ), counted AS (
            SELECT *, epochs + CASE WHEN epochs < 2
                      AND before * 2 + size <= (target - epochs * source_size) * 2 THEN 1 ELSE 0 END AS copies
            FROM placed
        ), shares AS (
            SELECT *, list_transform(range(0, copies), lambda e: CASE WHEN target > 0
                      THEN least((e * source_size + before + size / 2.0::DOUBLE) / target, 1) ELSE 0 END) AS share
            FROM counted
        ), timed AS (
            SELECT *, list_transform(share, lambda s: CASE turn % 3
                WHEN 0 THEN CASE
                    WHEN s <= 0.625::DOUBLE THEN s * 2 / (1.5::DOUBLE + sqrt(2.25::DOUBLE - s * 2))
                    ELSE 0.5::DOUBLE + (s - 0.625::DOUBLE) * 2 / (1 + sqrt(1 - (s - 0.625::DOUBLE) * 2)) END
                WHEN 1 THEN s
                ELSE CASE
                    WHEN s * 0.84375::DOUBLE <= 0.46875::DOUBLE
                    THEN s * 0.84375::DOUBLE * 2 / (0.25::DOUBLE + sqrt(s * 0.84375::DOUBLE * 2 + 0.0625::DOUBLE))
                    ELSE 0.75::DOUBLE + (s * 0.84375::DOUBLE - 0.46875::DOUBLE) * 2
                         / (1 + sqrt((s * 0.84375::DOUBLE - 0.46875::DOUBLE) * 8 + 1)) END
                END) AS positions
            FROM shares
        )
        SELECT doc_id, size, source_size, target, size * copies AS taken,
               positions[1] AS first_position, positions[copies] AS last_position
        FROM timed
    """,
    "op9_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
               count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
    """,
    "op13_phrases": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents
        ), worded AS (
            SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
        ), grams AS (
            SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2),
                                                  lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
            FROM worded, (SELECT unnest([1, 2, 3]) AS k)
        ), counted AS (
            SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL
        ), totals AS (
            SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counted WHERE k = 1 GROUP BY lang
        ), candidates AS (
            SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM counted WHERE k > 1 AND f >= 10
        ), cuts AS (
            SELECT c.lang, c.k, c.phrase, c.a, cut, x.f AS l, y.f AS r,
                   CAST((c.a::HUGEINT * c.a * 1000000) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
            FROM (SELECT *, unnest(range(1, k)) AS cut FROM candidates) AS c
            JOIN counted AS x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:cut], ' ')
            JOIN counted AS y ON y.lang = c.lang AND y.phrase = array_to_string(w[cut + 1:], ' ')
        ), scored AS (
            SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
        ), inner_parts AS (
            SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a
            FROM candidates WHERE k = 3
        ), within AS (
            SELECT lang, phrase, max(a) AS most FROM inner_parts GROUP BY ALL
        ), kept AS (
            SELECT s.* FROM scored AS s LEFT JOIN within AS i USING (lang, phrase)
            WHERE most IS NULL OR 100 * most < 50 * s.a
        )
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
               phrase, a, l, r, n, score
        FROM kept JOIN totals USING (lang)
        QUALIFY rank <= 2000
    """,
}
