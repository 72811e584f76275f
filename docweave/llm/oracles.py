"""DuckDB SQL for the queries that SQL can express, written from the definitions and not from the operators."""

from __future__ import annotations

_OCTET = "0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(length({_DIGITS})), lambda k: CASE WHEN k % 2 = 0 THEN reverse({_DIGITS})[k + 1]::INT WHEN reverse({_DIGITS})[k + 1]::INT > 4 THEN 2 * reverse({_DIGITS})[k + 1]::INT - 9 ELSE 2 * reverse({_DIGITS})[k + 1]::INT END)) % 10 = 0"
_TURNED = "regexp_replace(m, '[^A-Z0-9]', '', 'g')[5:] || regexp_replace(m, '[^A-Z0-9]', '', 'g')[:4]"
_MOD97 = f"list_reduce(list_prepend(0, list_transform(string_split({_TURNED}, ''), lambda c: CASE WHEN c >= 'A' THEN ascii(c) - 55 ELSE ascii(c) - 48 END)), lambda a, x: CASE WHEN x > 9 THEN (a * 100 + x) % 97 ELSE (a * 10 + x) % 97 END) = 1"
#: kind, pattern, which matches count
_KINDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", f"regexp_full_match(m, '{_OCTET}([.]{_OCTET}){{3}}')"),
    ("card", r"[0-9]([\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 13 AND 19 AND {_LUHN}"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15"),
    ("iban", r"[A-Z]{2}[0-9]{2}(\x20?[A-Z0-9]{4}){2,7}(\x20?[A-Z0-9]{1,3})?", _MOD97),
    ("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "NOT regexp_matches(m, '^(000|666|9)|-00-|-0000$') AND regexp_matches(lower(near), 'ssn|social security|taxpayer')"),
)


def _pii() -> str:
    found = ", ".join(f"regexp_extract_all(t, '{p}') AS {k}_m, string_split_regex(t, '{p}') AS {k}_g" for k, p, _ in _KINDS)

    def spans(k: str, ok: str) -> str:
        at = f"list_sum(list_transform({k}_g[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform({k}_m[1:i - 1], lambda x: length(x))), 0)::BIGINT"
        near = f"concat_ws(' ', CASE WHEN i > 1 THEN right({k}_g[i - 1], 40) END, right({k}_g[i], 40), left({k}_g[i + 1], 40))"
        return f"(SELECT coalesce(list('{k}:' || a || ':' || (a + length(m)) ORDER BY a), []) FROM (SELECT {k}_m[i] AS m, {at} AS a, {near} AS near FROM (SELECT unnest(range(1, len({k}_m) + 1)) AS i)) WHERE {ok}) AS {k}"

    every = ", ".join(spans(k, ok) for k, _, ok in _KINDS)
    joined = lambda kinds: "array_to_string(" + " || ".join(kinds) + ", ',')"
    names = [k for k, _, _ in _KINDS]
    counts = ", ".join(f"len({k})::BIGINT AS n_{k}" for k in names[:4])
    return f"""WITH d AS (SELECT doc_id, {found} FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)), s AS (SELECT doc_id, {every} FROM d)
    SELECT doc_id, {counts}, sha256({joined(names[:4])}) AS base_sha256, {joined(names)} AS spans FROM s"""


PII = _pii()

PASSAGES = r"""WITH w AS (SELECT doc_id, row, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM (SELECT *, row_number() OVER () AS row FROM documents)),
  windows AS (SELECT row, i, md5(array_to_string(words[i:i + 34], ' ')) AS h FROM (SELECT row, words, unnest(range(1, len(words) - 33)) AS i FROM w WHERE len(words) >= 35)),
  gone AS (SELECT DISTINCT row, unnest(range(i, i + 35)) AS i FROM windows WHERE h IN (SELECT h FROM windows GROUP BY h HAVING count(*) > 1)),
  n AS (SELECT row, count(*) AS n FROM gone GROUP BY 1),
  kept AS (SELECT row, string_agg(word, ' ' ORDER BY i) AS kept FROM (SELECT row, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w) ANTI JOIN gone USING (row, i) GROUP BY 1)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN n USING (row) LEFT JOIN kept USING (row)"""
