"""The registered queries of the operators, over whole tables, and their SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coterie.llm.byte_bpe import round_trip
from coterie.llm.embedding_dedup import link_embeddings
from coterie.llm.exact_topk import top_k
from coterie.llm.line_dedup import drop_repeated_lines
from coterie.llm.merkle import prove_documents
from coterie.llm.ngram_join import link_documents
from coterie.llm.packing import pack_pieces, token_pieces
from coterie.llm.personal_data import find_personal_data
from coterie.llm.prefix_trie import conversation_trie
from coterie.llm.quotations import link_quotations
from coterie.llm.tables import ship, stage
from coterie.llm.token_counts import count_tokens
from coterie.llm.token_files import read_token_files, write_token_files
from coterie.llm.toxicity import classify
from coterie.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its own name; its code goes to the executors first."""

    def register(function):
        @functools.wraps(function)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return function(spark, sf_dir)

        QUERIES[function.__name__] = run
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    r"""
    WITH lines AS (
        SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
        FROM documents
    ), keyed AS (
        SELECT doc_id, line, place, translate(
            regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
        FROM lines
    ), repeated AS (
        SELECT key, max(doc_id) AS keeper
        FROM (SELECT DISTINCT key, doc_id FROM keyed WHERE length(key) >= 40)
        GROUP BY key HAVING count(*) >= 5
    ), marked AS (
        SELECT doc_id, line, place, keeper IS NOT NULL AND doc_id <> keeper AS gone
        FROM keyed LEFT JOIN repeated USING (key)
    )
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), ''))
               AS kept_sha256
    FROM marked GROUP BY doc_id
    """
)
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")
    )


@query(
    r"""
    WITH RECURSIVE words AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
        FROM documents
    ), sets AS (
        SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
            ELSE list_transform(range(1, len(w) - 2), lambda k: array_to_string(w[k:k + 3], ' ')) END) AS grams
        FROM words
    ), members AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM sets),
    links AS (
        SELECT a.doc_id AS x, b.doc_id AS y
        FROM members a JOIN members b ON a.gram = b.gram AND a.doc_id <> b.doc_id
            AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
        GROUP BY x, y HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))
    ), reach AS (
        SELECT doc_id AS x, doc_id AS y FROM sets
        UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y
    )
    SELECT x AS doc_id, any_value(len(grams))::BIGINT AS n_shingles, min(y) AS component_id
    FROM reach JOIN sets ON sets.doc_id = x GROUP BY x
    """
)
def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(table(spark, sf_dir, "documents"))


@query(
    """
    WITH RECURSIVE v AS (
        SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
        WHERE embedding IS NOT NULL AND len(embedding) = len(list_filter(embedding, lambda x: isfinite(x)))
          AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    ), links AS (
        SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b
        ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9
    ), reach AS (
        SELECT vec_id AS x, vec_id AS y FROM embeddings
        UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y
    ), roots AS (SELECT x AS vec_id, min(y) AS component_id FROM reach GROUP BY x),
    counts AS (SELECT x AS vec_id, count(*) AS n_links FROM links GROUP BY x)
    SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
    FROM roots LEFT JOIN counts USING (vec_id)
    """
)
def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_embeddings(table(spark, sf_dir, "embeddings"))


@query()
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUOTATION_SQL = r"""
    WITH RECURSIVE messages AS (
        SELECT row_number() OVER () AS id, conv_id, turn, role, coalesce(text, '') AS text
        FROM conversations
    ), lines AS (
        SELECT id, unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) AS place
        FROM messages
    ), marked AS (
        SELECT id, place, line, length(regexp_replace(
                   regexp_extract(line, '^((?:[ 	]*>)+)', 1), '[^>]', '', 'g')) AS depth,
               regexp_replace(line, '^(?:[ 	]*>)+[ 	]?', '') AS rest
        FROM lines
    ), own AS (
        SELECT id, CASE WHEN bool_or(depth > 0) THEN regexp_replace(
                   coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE depth = 0), ''),
                   '^(?:[ 	
]*
)+|(?:
[ 	
]*)+$', '', 'g')
               ELSE string_agg(line, chr(10) ORDER BY place) END AS text
        FROM marked GROUP BY id
    ), runs AS (
        SELECT *, place - row_number() OVER (PARTITION BY id, depth ORDER BY place) AS run FROM marked
    ), passages AS (
        SELECT id, depth, min(place) AS passage, string_agg(rest, chr(10) ORDER BY place) AS whole,
               list(rest ORDER BY place) AS rests
        FROM runs WHERE depth > 0 GROUP BY id, depth, run
    ), asked AS (
        SELECT id, passage, depth, 0 AS part, whole AS unit FROM passages
        UNION ALL SELECT id, passage, depth, 1, unnest(rests) FROM passages
    ), asked_normal AS (
        SELECT id, passage, depth, part, trim(regexp_replace(translate(unit,
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ 	-
]+', ' ', 'g'), ' ') AS unit
        FROM asked
    ), units AS (
        SELECT id, unnest([text] || regexp_split_to_array(text, '
[ 	
]*
') || string_split(text, chr(10))) AS unit
        FROM own
    ), firsts AS (
        SELECT conv_id, trim(regexp_replace(translate(unit,
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ 	-
]+', ' ', 'g'), ' ') AS unit,
            min(turn) AS first
        FROM units JOIN messages USING (id) GROUP BY ALL
    ), matched AS (
        SELECT a.id, a.passage, a.depth, min((a.part, -f.first)) AS best
        FROM asked_normal a JOIN messages m USING (id) JOIN firsts f USING (conv_id, unit)
        WHERE a.unit <> '' AND f.first < m.turn GROUP BY ALL
    ), linked AS (
        SELECT id, count(*) AS n_linked, min((depth, best[1], best[2])) AS chosen FROM matched GROUP BY id
    ), counted AS (SELECT id, count(*) AS n_quotes FROM passages GROUP BY id),
    replies AS (
        SELECT m.*, -(l.chosen[3])::BIGINT AS reply_to, coalesce(l.n_linked, 0) AS n_linked,
               coalesce(c.n_quotes, 0) AS n_quotes
        FROM messages m LEFT JOIN linked l USING (id) LEFT JOIN counted c USING (id)
    ), parents AS (
        SELECT conv_id, turn, min(reply_to) AS parent FROM replies WHERE reply_to IS NOT NULL GROUP BY ALL
    ), up(conv_id, turn, thread) AS (
        SELECT conv_id, turn, parent FROM parents
        UNION SELECT up.conv_id, up.turn, p.parent FROM up
        JOIN parents p ON p.conv_id = up.conv_id AND p.turn = up.thread
    ), roots AS (SELECT conv_id, turn, min(thread) AS thread FROM up GROUP BY ALL)
    SELECT r.conv_id, r.turn, r.role, o.text, r.n_quotes, r.n_linked, r.reply_to,
           coalesce(roots.thread, r.turn) AS thread,
           row_number() OVER (PARTITION BY r.conv_id ORDER BY coalesce(roots.thread, r.turn) NULLS FIRST,
               r.turn NULLS FIRST, r.role NULLS FIRST, sha256(r.text)) - 1 AS position
    FROM replies r JOIN own o USING (id)
    LEFT JOIN roots ON roots.conv_id = r.conv_id AND roots.turn = r.turn
"""


@query(QUOTATION_SQL)
def op4_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotations(table(spark, sf_dir, "conversations"))


@query()
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = token_pieces(table(spark, sf_dir, "documents")).select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "deal"
    )
    return pack_pieces(stage(pieces, "pieces")).drop("deal")


@query()
def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents")).select(
        "doc_id",
        F.octet_length("ids").cast("long").alias("len"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    ).select("doc_id", (F.col("len") / 4).cast("long").alias("n_tokens"), "ids_sha256", "decoded_sha256")


@query()
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


@query()
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path, end_id=2)
    return read_token_files(spark, path).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


@query(
    """
    WITH v AS (
        SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor(1024 * x)) AS e
        FROM embeddings
        WHERE embedding IS NOT NULL AND len(embedding) = len(list_filter(embedding, lambda x: isfinite(x)))
    ), scored AS (
        SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
        FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
    ), ranked AS (
        SELECT query_id, vec_id, score,
               row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank
        FROM scored
    )
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
    """
)
def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 100 = 0"))


def crc32_sql(text: str) -> str:
    """DuckDB's crc32 of an ASCII text: its bytes, each followed by eight steps (-1)."""
    steps = (
        f"flatten(list_transform(range(1, length({text}) + 1), "
        f"lambda k: [unicode(substr({text}, k, 1))::BIGINT] || list_transform(range(8), lambda i: -1::BIGINT)))"
    )
    step = (
        "lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) "
        "ELSE xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END) END"
    )
    return f"xor(list_reduce([4294967295::BIGINT] || {steps}, {step}), 4294967295::BIGINT)"


def field_sql(name: str) -> str:
    return f"coalesce(strlen({name}::VARCHAR)::VARCHAR || ':' || {name}::VARCHAR, '-')"


MERKLE_SQL = f"""
    WITH RECURSIVE shown AS (
        SELECT *, CASE WHEN doc_id IS NOT NULL AND {crc32_sql('doc_id::VARCHAR')} % 5 = 0
            THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS other
        FROM documents
    ), hashed AS (
        SELECT doc_id, source,
            sha256(concat({', '.join(map(field_sql, ('doc_id', 'source', 'lang', 'n_chars', 'text')))})) AS leaf,
            sha256(concat({', '.join(map(field_sql, ('doc_id', 'source', 'lang', 'n_chars', 'other')))})) AS shown
        FROM shown
    ), leaves AS (
        SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
            count(*) OVER (PARTITION BY source) AS size, row_number() OVER () AS id
        FROM hashed
    ), nodes(tree, level, place, size, hash) AS (
        SELECT source, 0, place, size, leaf FROM leaves
        UNION ALL
        SELECT tree, max(level) + 1, place >> 4, (max(size) + 15) >> 4, sha256(string_agg(hash, '' ORDER BY place))
        FROM nodes WHERE size > 1 GROUP BY tree, place >> 4
    ), tops AS (
        SELECT tree, hash, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS place, count(*) OVER () AS size
        FROM nodes WHERE size = 1
    ), over_nodes(level, place, size, hash) AS (
        SELECT 0, place, size, hash FROM tops
        UNION ALL
        SELECT max(level) + 1, place >> 4, (max(size) + 15) >> 4, sha256(string_agg(hash, '' ORDER BY place))
        FROM over_nodes WHERE size > 1 GROUP BY place >> 4
    ), runs AS (
        SELECT tree, level, place >> 4 AS run, list(hash ORDER BY place) AS hashes
        FROM nodes WHERE size > 1 GROUP BY ALL
    ), over_runs AS (
        SELECT level, place >> 4 AS run, list(hash ORDER BY place) AS hashes
        FROM over_nodes WHERE size > 1 GROUP BY ALL
    ), up(id, source, level, place, proof, value) AS (
        SELECT id, source, 0, place, '', shown FROM leaves
        UNION ALL
        SELECT id, source, up.level + 1, place >> 4,
            proof || array_to_string(hashes[:place & 15] || hashes[(place & 15) + 2:], ''),
            sha256(array_to_string(hashes[:place & 15] || [value] || hashes[(place & 15) + 2:], ''))
        FROM up JOIN runs ON runs.tree IS NOT DISTINCT FROM source AND runs.level = up.level AND run = place >> 4
    ), within AS (SELECT id, arg_max(proof, level) AS proof, arg_max(value, level) AS value FROM up GROUP BY id),
    further(id, level, place, proof, value) AS (
        SELECT id, 0, tops.place, proof, value
        FROM within JOIN leaves USING (id) JOIN tops ON tops.tree IS NOT DISTINCT FROM source
        UNION ALL
        SELECT id, further.level + 1, place >> 4,
            proof || array_to_string(hashes[:place & 15] || hashes[(place & 15) + 2:], ''),
            sha256(array_to_string(hashes[:place & 15] || [value] || hashes[(place & 15) + 2:], ''))
        FROM further JOIN over_runs ON over_runs.level = further.level AND run = place >> 4
    ), folded AS (SELECT id, arg_max(proof, level) AS proof, arg_max(value, level) AS value FROM further GROUP BY id)
    SELECT doc_id, leaf, tops.hash AS subroot, root, sha256(proof) AS proof_sha256,
        value AS folded_root, value = root AS verified
    FROM leaves JOIN folded USING (id) JOIN tops ON tops.tree IS NOT DISTINCT FROM source,
        (SELECT hash AS root FROM over_nodes WHERE size = 1)
"""


@query(MERKLE_SQL)
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prove_documents(table(spark, sf_dir, "documents"))


@query(
    f"""
    WITH turns AS (
        SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
            row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, '')) AS place
        FROM conversations WHERE conv_id IS NOT NULL
    ), talks AS (
        SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY place) AS said,
            {crc32_sql('conv_id::VARCHAR')} % 9 AS h
        FROM turns GROUP BY conv_id
    ), rebuilt AS (
        SELECT t.conv_id, coalesce(b.said[:t.h], []) || t.said[t.h + 1:] AS said
        FROM talks t LEFT JOIN talks b ON b.conv_id = t.conv_id - t.conv_id % 5
    ), places AS (
        SELECT conv_id, said[:d] AS said, d AS depth, said[d]['text'] AS last, d = len(said) AS ends
        FROM (SELECT conv_id, said, unnest(range(len(said) + 1)) AS d FROM rebuilt)
    ), nodes AS (
        SELECT said, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
            (count(*) - 1) * any_value(coalesce(strlen(last), 0)) AS saved,
            coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '') AS ended
        FROM places GROUP BY said, depth
    ), linked AS (
        SELECT n.*, p.conv_id AS parent_conv_id,
            (SELECT count(*) FROM nodes c WHERE c.depth = n.depth + 1 AND c.said[:n.depth] = n.said) AS n_children
        FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.said = n.said[:n.depth - 1]
    ), paths AS (SELECT *, unnest(range(depth + 1)) AS above FROM linked)
    SELECT n.conv_id, n.depth, n.parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens,
        sha256(n.ended) AS ends_sha256
    FROM linked n JOIN (
        SELECT said[:above] AS said, above AS depth, count(*) FILTER (WHERE n_children = 0) AS n_leaves,
            sum(saved)::BIGINT AS saved_tokens
        FROM paths GROUP BY ALL
    ) s ON s.said = n.said AND s.depth = n.depth
    """
)
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


@query()
def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))
