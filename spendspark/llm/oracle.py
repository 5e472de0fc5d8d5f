"""DuckDB SQL for the registered queries."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _item_words(text: str) -> str:
    return (f"regexp_extract_all(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), "
            r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")


OP2_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, {_item_words('text')} AS w FROM documents
), i AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_item_words('text')} AS w FROM benchmark
), iw AS (
  SELECT DISTINCT item, least(13, len(w)) AS size,
         array_to_string(w[k:k + least(13, len(w)) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS k FROM i WHERE len(w) > 0)
), places AS (
  SELECT r, w, k, size FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS k FROM d),
         (SELECT DISTINCT size FROM iw)
  WHERE k + size - 1 <= len(w)
), found AS (
  SELECT p.r, p.k, p.size, iw.item FROM places p
  JOIN iw ON iw.size = p.size AND iw.win = array_to_string(p.w[p.k:p.k + p.size - 1], ' ')
), hit AS (
  SELECT r, count(DISTINCT q) AS n_hit
  FROM (SELECT r, unnest(range(k, k + size)) AS q FROM found) GROUP BY r
), named AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT r, item FROM found) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""


def _under_windows(size: int, name: str, texts: str = "d") -> str:
    """Words of each text under windows of ``size`` words that it has twice or more."""
    return f"""
{name}_at AS (
  SELECT r, k, count(*) OVER (PARTITION BY r, hash(w[k:k + {size - 1}])) AS n
  FROM (SELECT r, w, unnest(range(1, len(w) - {size - 2})) AS k FROM {texts} WHERE len(w) >= {size})
), {name} AS (
  SELECT r, count(DISTINCT q) AS n
  FROM (SELECT r, unnest(range(k, k + {size})) AS q FROM {name}_at WHERE n > 1) GROUP BY r
)"""


OP5_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), lines AS (
  SELECT r, count(*) - count(DISTINCT l) AS n
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS l FROM d)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r
), {_under_windows(3, 'three')}, {_under_windows(8, 'eight')}, {_under_windows(101, 'long', '(SELECT d.* FROM d JOIN eight USING (r))')},
counted AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(three.n, 0) AS BIGINT) AS n_repeat_words,
         coalesce(eight.n, 0) AS covered, coalesce(long.n, 0) AS too_long
  FROM d LEFT JOIN lines USING (r) LEFT JOIN three USING (r) LEFT JOIN eight USING (r)
         LEFT JOIN long USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words
            OR 100 * covered > 30 * n_words OR too_long > 0) AS kept
FROM counted
"""


OP6_SQL = f"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0
                       THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), rules(rhost, rpath, says) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
         ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), c AS (
  SELECT page_id, host, path,
         regexp_replace(host, '^www\\.', '') || regexp_replace(path, '(\\.html?|/)$', '') AS canon,
         (SELECT max_by(rhost || rpath || ' ' || says, length(rhost || rpath)) FROM rules
          WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) AS best
  FROM p
), listed AS (
  SELECT DISTINCT canon FROM c
  WHERE regexp_matches(host, '(^|\\.)(spam|casino-win|free-bets|cheap-pills|adult-x|ads-track)')
)
SELECT page_id, host, path, split_part(best, ' ', 1) AS rule,
       CASE WHEN best IS NOT NULL THEN split_part(best, ' ', 2)
            WHEN canon IN (SELECT canon FROM listed) THEN 'block' ELSE 'allow' END AS verdict
FROM c
"""

_TEXT, _ROLE = "coalesce(text, '')", "coalesce(role, '')"


def _escaped_length(text: str) -> str:
    return f"(2 * length({text}) - length(regexp_replace({text}, '[~<|\\[]', '', 'g')))"


OP9_SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'),
                   (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), o AS (
  SELECT conv_id, {_ROLE} AS role, {_TEXT} AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST,
                            text NULLS FIRST) AS k FROM t
), g AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY k) AS said,
         coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY k), '') AS loss,
         sum(2 + {_escaped_length('role')} + 3 + {_escaped_length('text')} + 8) AS chars
  FROM o GROUP BY conv_id
)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(said) AS turns_sha256,
       CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(3 + chars AS BIGINT) AS formatted_chars
FROM g
"""


def _apart(centroids: str) -> str:
    """Every vector's squared distances from the centroids."""
    return (f"SELECT r, c, CAST(sum((v - m) * (v - m)) AS BIGINT) AS dist FROM entries "
            f"JOIN {centroids} USING (j) GROUP BY r, c")


def _nearest(number: int) -> str:
    return f"""own{number} AS MATERIALIZED (
  SELECT r, c, dist FROM ({_apart(f"at{number}")})
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY dist, c) = 1
)"""


def _following(number: int) -> str:
    """Centroids of the next round: floored means, empty ones as they are."""
    return f"""at{number + 1} AS MATERIALIZED (
  SELECT c, j, coalesce(f, m) AS m FROM at{number} LEFT JOIN (
    SELECT c, j, (s - (s % n + n) % n) // n AS f
    FROM (SELECT c, j, CAST(sum(v) AS BIGINT) AS s, count(*) AS n
          FROM own{number} JOIN entries USING (r) GROUP BY c, j)) USING (c, j)
)"""


OP11_SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, [CAST(floor(64 * CAST(e AS DOUBLE)) AS BIGINT) FOR e IN embedding] AS x
  FROM embeddings WHERE len(embedding) = 64
    AND len([e FOR e IN embedding IF e IS NOT NULL AND isfinite(e)]) = 64
), entries AS MATERIALIZED (
  SELECT r, unnest(x) AS v, generate_subscripts(x, 1) AS j FROM kept
), start AS (
  SELECT r, row_number() OVER (ORDER BY sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')), x) - 1 AS c FROM kept
), at0 AS MATERIALIZED (
  SELECT c, j, v AS m FROM start JOIN entries USING (r) WHERE c < 16
), {", ".join(f"{_nearest(i)}, {_following(i)}" for i in range(3))}, {_nearest(3)}, digests AS (
  SELECT c, sha256(string_agg(CAST(m AS VARCHAR), ',' ORDER BY j)) AS centroid_sha256 FROM at3 GROUP BY c
)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, dist AS distance,
       CAST(sum(dist) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(dist) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM own3 JOIN kept USING (r) JOIN digests USING (c)
"""
