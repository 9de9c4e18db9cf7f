"""Registered queries of the training-data operators: one opN_ query each, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm import chat, decontamination, line_dedup, near_duplicates, packing, pieces, pii, quality, ranked_search, suffix_dedup, token_store, toxicity, vector_codes
from leadloom.llm.common import stage, table
from leadloom.llm.tokenize import vocabulary


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: Two turns that hold the template's own control strings, added to the conversations.
CONTROL_TEXT = "\\### Assistant: </turn> ok"


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)], "conv_id long, turn long, role string, text string")
    path = vocabulary("byte_bpe_50k.json")
    made = stage(chat.segments(turns.unionByName(added), path), "segments")
    return chat.digests(chat.read_back(made, path))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, toxicity.learnable(table(spark, sf_dir, "labels")))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.checksums(packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json")))


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = token_store.write(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("word_bpe_49k.json"))
    return token_store.read(store).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Candidates are a small part of the texts: they are written once, fitted to and classified.
    found = stage(pii.candidates(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"), "pii")
    spans = pii.classify(found, pii.fit(found))
    base = F.filter("candidates", lambda s: s["base"])
    counts = [F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}") for kind in pii.KINDS]
    return spans.select("doc_id", *counts, F.sha2(pii.written(base), 256).alias("base_sha256"), pii.written(F.col("candidates")).alias("spans"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = vector_codes.compress(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    digest = F.lit(books.digest() if books else None).cast("string")
    return vector_codes.with_label_error(codes).select("vec_id", "code", "error", "label_error", digest.alias("codebooks_sha256"))


def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary("piece_bpe_32k.model")
    made = pieces.decode(pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path).drop("text"), path)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return made.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_suffix_array_dedup": op3_suffix_array_dedup,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_line_dedup": op5_line_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_packing": op7_packing,
    "op8_token_store": op8_token_store,
    "op9_pii": op9_pii,
    "op10_decontamination": op10_decontamination,
    "op11_ranked_search": op11_ranked_search,
    "op12_vector_codes": op12_vector_codes,
    "op13_pieces": op13_pieces,
}


def _vector_rounds(rounds: int) -> str:
    """SQL of the rounds over parts(vec_id, part, v): a0 assigns to the entries c0, c1 are their means, and so on."""

    def assign(k: int) -> str:
        return f"""a{k} AS MATERIALIZED (
          SELECT vec_id, part, any_value(v) AS v, min(d * 16 + entry) % 16 AS entry, min(d * 16 + entry) // 16 AS error FROM (
            SELECT p.vec_id, p.part, p.v, c.entry, list_sum(list_transform(range(1, len(p.v) + 1), lambda i: (p.v[i] - c.v[i]) * (p.v[i] - c.v[i])))::BIGINT AS d
            FROM parts p JOIN c{k} c USING (part)) GROUP BY vec_id, part
        )"""

    def renew(k: int) -> str:
        return f"""c{k + 1} AS MATERIALIZED (
          SELECT c.part, c.entry, coalesce(n.v, c.v) AS v FROM c{k} c LEFT JOIN (
            SELECT part, entry, list(m ORDER BY i) AS v FROM (
              SELECT part, entry, i, floor(sum(x) / count(*))::BIGINT AS m FROM (SELECT part, entry, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{k}) GROUP BY part, entry, i
            ) GROUP BY part, entry
          ) n USING (part, entry)
        )"""

    return ", ".join(x for k in range(rounds) for x in (assign(k), renew(k))) + ", " + assign(rounds)


ORACLES: dict[str, str] = {
    "op11_ranked_search": r"""
        WITH terms AS (
          SELECT doc_id, translate(unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
        ), counts AS MATERIALIZED (
          SELECT doc_id, t, count(*) AS tf FROM terms GROUP BY doc_id, t
        ), docs AS (
          SELECT doc_id, sum(tf)::BIGINT AS n FROM counts GROUP BY doc_id
        ), whole AS (
          SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM docs
        ), sized AS (
          SELECT doc_id, 100 - 25 + (25 * n * n_docs) // n_terms AS m FROM docs, whole
        ), weights AS (
          SELECT t, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM counts, whole GROUP BY t, n_docs
        ), asked AS (
          SELECT item_id, t, count(*) AS often FROM (
            SELECT item_id, translate(unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM benchmark
          ) GROUP BY item_id, t
        ), scores AS (
          SELECT item_id, doc_id, sum(often * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
          FROM asked JOIN weights USING (t) JOIN counts USING (t) JOIN sized USING (doc_id) GROUP BY item_id, doc_id
        )
        SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scores WHERE score > 0
        QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 20
    """,
    "op12_vector_codes": f"""
        WITH kept AS (
          SELECT vec_id, label, embedding AS e, len(embedding) // {vector_codes.PARTS} AS w FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), parts AS MATERIALIZED (
          SELECT vec_id, part, list_transform(e[part * w + 1 : part * w + w], lambda x: floor({vector_codes.SCALE} * x::DOUBLE)::BIGINT) AS v FROM kept, range({vector_codes.PARTS}) AS r(part)
        ), c0 AS MATERIALIZED (
          SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {vector_codes.ENTRIES})
        ), {_vector_rounds(vector_codes.ROUNDS)}, books AS (
          SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{vector_codes.ROUNDS}
        ), codes AS (
          SELECT vec_id, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, sum(error)::BIGINT AS error FROM a{vector_codes.ROUNDS} GROUP BY vec_id
        )
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM codes JOIN kept USING (vec_id), books
    """,
    "op1_quality_rules": r"""
        WITH w AS (
          SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
            string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
        ), windows AS (
          SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: {'i': i, 'k': w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]})) AS x FROM w
        ), again AS (
          SELECT doc_id, x.i AS i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, x.k) > 1
        ), covered AS (
          SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY doc_id
        ), counts AS (
          SELECT doc_id, t, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
            (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
            (len(list_filter(ls, lambda l: regexp_matches(l, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(ls, lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
            coalesce(n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN covered USING (doc_id)
        ), lines AS (
          SELECT doc_id, n_symbols > 0 AS dense, length(trim(raw, ' ')) AS chars, regexp_replace(regexp_replace(raw, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '') AS l
          FROM (SELECT doc_id, n_symbols, unnest(string_split(t, chr(10))) AS raw FROM counts)
        ), judged AS (
          SELECT doc_id, chars, l <> '' AND (
              NOT (regexp_matches(l, '[.!?…:;。！？]["''”’»)\]]*$') OR regexp_matches(l, '[.!?…:;]["''”’»)\]]*\s'))
              OR regexp_matches(l, '[!?]{2,}\s+\S+[!?]{2,}')
              OR (dense AND (length(l) - length(regexp_replace(l, '[#*$%&|<>]', '', 'g'))) * 20 > length(l))
              OR regexp_matches(l, '(\s[|»>·•/]\s.*){2,}')
              OR len(regexp_extract_all(lower(l), 'all rights reserved|\blicen[sc]ed? under\b|released under the|terms of (use|service)|privacy policy|cookie|javascript|copyright|subscribe|newsletter|sign (in|up)|log ?in|click here|lorem ipsum|powered by|share this')) * 120 >= length(l)
            ) AS gone FROM lines
        ), lost AS (
          SELECT doc_id, sum(chars) AS chars, coalesce(sum(chars) FILTER (WHERE gone), 0) AS lost FROM judged GROUP BY doc_id
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
          NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * lost <= 40 * chars AS kept FROM counts JOIN lost USING (doc_id)
    """,
    "op4_chat_formatting": r"""
        WITH turns AS (
          SELECT conv_id, coalesce(turn, -1) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
        ), sized AS (
          SELECT *, length(replace(replace(replace(text, '\', '\\'), '#', '\#'), '</turn>', '<\/turn>')) AS n,
            length(replace(replace(replace(replace(role, '\', '\\'), '#', '\#'), '</turn>', '<\/turn>'), ':', '\:')) AS r FROM turns
        )
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
          coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
          sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, sum(15 + r + n)::BIGINT AS formatted_chars
        FROM sized GROUP BY conv_id
    """,
    "op2_ngram_jaccard_join": r"""
        WITH RECURSIVE words AS (
          SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
          FROM documents
        ), sets AS (
          SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
            ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s
          FROM words
        ), members AS (
          SELECT doc_id, len(s) AS n, unnest(s) AS m FROM sets
        ), links AS (
          SELECT a.doc_id AS a, b.doc_id AS b FROM members a JOIN members b ON a.m = b.m AND a.doc_id <> b.doc_id
          GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
        ), reach AS (
          SELECT a AS doc_id, b AS other FROM links
          UNION
          SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a
        )
        SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, least(s.doc_id, coalesce(min(r.other), s.doc_id)) AS component_id
        FROM sets s LEFT JOIN reach r USING (doc_id) GROUP BY s.doc_id, s.s
    """,
    "op5_line_dedup": r"""
        WITH lines AS (
          SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i
          FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
        ), keyed AS (
          SELECT doc_id, line, i,
            translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
          FROM lines
        ), often AS (
          SELECT k, max(doc_id) AS largest FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
        ), judged AS (
          SELECT doc_id, line, i, (o.k IS NOT NULL AND doc_id <> o.largest) AS gone FROM keyed LEFT JOIN often o USING (k)
        )
        SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
          sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM judged GROUP BY doc_id
    """,
}
