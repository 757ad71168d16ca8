"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ship
from .arrow_ids import op4_arrow_sequences
from .chunk_bpe import op6_distinct_chunks
from .compression import op1_compression_bands
from .containment import op3_size_partitioned_containment
from .ecoc import op9_output_codes
from .licenses import op10_license_classifier
from .minmax import op8_minmax_dedup
from .pii import op2_boosted_candidates
from .stratified import op7_stratified_interleaving
from .trigram import BASE, MORE, op5_trigram_index

Query = Callable[[SparkSession, str], DataFrame]
_ALL: list[Query] = [op1_compression_bands, op2_boosted_candidates, op3_size_partitioned_containment, op4_arrow_sequences, op5_trigram_index, op6_distinct_chunks, op9_output_codes, op7_stratified_interleaving, op8_minmax_dedup, op10_license_classifier]


def _shipped(f: Query) -> Query:
    return lambda spark, sf_dir: f(ship(spark), sf_dir)


QUERIES: dict[str, Query] = {f.__name__: _shipped(f) for f in _ALL}

#: From a relation's text, lower-cased in A-Z, to its distinct 5-word shingles; fewer words are one shingle.
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SHINGLES = f"""(SELECT {{key}}, unnest(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s
FROM (SELECT {{key}}, list_filter(string_split_regex({_LOW}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM {{table}}))"""

#: The plain rules of op5: kind, expression, condition on a match.
_PLAIN = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "length(regexp_extract(m, p, 2)) >= 6"),
    ("access", r"AKIA[A-Z0-9]+", "length(m) >= 20"),
    ("hex", r"[0-9a-f]+", "length(m) >= 24"),
    *((r.kind, r.pattern, "true") for r in MORE),
)
_MATCHES = " UNION ALL ".join(
    f"SELECT doc_id, '{kind}' AS kind, {k} AS rank, p, regexp_extract_all(text, p) AS ms, string_split_regex(text, p) AS gs FROM (SELECT doc_id, text, '{pattern.replace(chr(39), chr(39) * 2)}' AS p FROM documents) WHERE regexp_matches(text, p)"
    for k, (kind, pattern, _) in enumerate(_PLAIN)
)
_KEPT = " ".join(f"WHEN '{kind}' THEN {ok}" for kind, _, ok in _PLAIN)

#: Codecs, checksums, hashes, trained models and library tokenizers are beyond SQL: tests/llm has brute-force versions.
ORACLE_SQL: dict[str, str] = {
    "op3_size_partitioned_containment": f"""WITH d AS {_SHINGLES.format(key="doc_id", table="documents")}, i AS {_SHINGLES.format(key="item_id", table="benchmark")}, n AS (SELECT item_id, count(*) AS n_item FROM i GROUP BY ALL),
h AS (SELECT doc_id, item_id, count(*) AS n_shared FROM d JOIN i USING (s) GROUP BY ALL)
SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item::DOUBLE AS containment FROM h JOIN n USING (item_id) WHERE n_shared >= 0.8 * n_item""",
    "op5_trigram_index": f"""WITH x AS ({_MATCHES}), y AS (SELECT doc_id, kind, rank, p, ms[i] AS m, list_sum(list_transform(gs[1:i], lambda g: length(g)))::BIGINT + coalesce(list_sum(list_transform(ms[1:i - 1], lambda g: length(g))), 0)::BIGINT AS start FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM x)),
z AS (SELECT *, kind || ':' || start || ':' || (start + length(m)) AS span FROM y WHERE CASE kind {_KEPT} END),
g AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k, _, _ in _PLAIN)}, count(*) AS n_spans, string_agg(span, ',' ORDER BY start, rank) AS spans, string_agg(span, ',' ORDER BY start, rank) FILTER (rank < {len(BASE)}) AS base FROM z GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k, _, _ in _PLAIN)}, coalesce(n_spans, 0) AS n_spans, coalesce(spans, '') AS spans, sha256(coalesce(base, '')) AS base_sha256 FROM documents d LEFT JOIN g USING (doc_id)""",
    "op8_minmax_dedup": f"""WITH RECURSIVE s AS MATERIALIZED {_SHINGLES.format(key="doc_id", table="documents")}, n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY ALL),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS low FROM r GROUP BY ALL)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id, d.doc_id <= coalesce(low, d.doc_id) AS kept FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)""",
}
