"""SQL for the corpus queries that SQL can express, for another engine over the same tables."""

from __future__ import annotations

import string

from .hard_negatives import EVERY, LOW, NEGATIVES, POSITIVES, WHOLE
from .pii import BASE, CONTEXT, IBAN, KINDS, NEAR, near_pattern
from .quality_rules import LEVEL, MAX_REJECTION, PATH, RULES, least_tested

#: The patterns of personal data as that engine spells them.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": rf"\b{IBAN}\b",
}


def _digits(value: str) -> str:
    return f"regexp_replace({value}, '[^0-9]', '', 'g')"


def _luhn(value: str) -> str:
    d = _digits(value)
    digit = f"CAST(substr({d}, length({d}) - k + 1, 1) AS INT)"
    return f"(length({d}) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length({d}) + 1), lambda k: CASE WHEN k % 2 = 1 THEN {digit} ELSE 2 * {digit} - CASE WHEN {digit} > 4 THEN 9 ELSE 0 END END)) % 10 = 0)"


def _mod97(value: str) -> str:
    plain = f"replace({value}, ' ', '')"
    signs = f"list_transform(string_split(substr({plain}, 5) || substr({plain}, 1, 4), ''), lambda c: CASE WHEN ascii(c) >= 65 THEN ascii(c) - 55 ELSE ascii(c) - 48 END)"
    return f"list_reduce({signs}, lambda r, n: (r * CASE WHEN n > 9 THEN 100 ELSE 10 END + n) % 97, 0) = 1"


_VALID = {
    "email": "TRUE",
    "ip": "len(list_filter(string_split(x.v, '.'), lambda p: NOT (length(ltrim(p, '0')) <= 3 AND CAST('0' || right(p, 3) AS INT) <= 255))) = 0",
    "card": _luhn("x.v"),
    "phone": f"length({_digits('x.v')}) BETWEEN 9 AND 15",
    "iban": _mod97("x.v"),
}


def pii() -> str:
    """Counts, hash, spans and scores of the PII query."""
    raw, spans, out = [], [], []
    for kind, pattern in PATTERNS.items():
        raw.append(f"regexp_extract_all(text, '{pattern}') AS m_{kind}, list_transform(string_split_regex(text, '{pattern}'), lambda g: length(g)) AS g_{kind}, string_split_regex(text, '{pattern}') AS t_{kind}")
        start = f"(list_sum(g_{kind}[1:i]) + coalesce(list_sum(list_transform(m_{kind}[1:i - 1], lambda m: length(m))), 0))"
        each = f"list_transform(range(1, len(m_{kind}) + 1), lambda i: {{'s': CAST({start} AS BIGINT), 'v': m_{kind}[i], 'near': lower(right(t_{kind}[i], {NEAR}) || ' ' || left(t_{kind}[i + 1], {NEAR}))}})"
        spans.append(f"list_filter({each}, lambda x: {_VALID[kind]}) AS {kind}")
        base, words = KINDS[kind][2], near_pattern(kind)
        near = f"regexp_matches(x.near, '{words}')"
        out.append((f"list_transform({kind}, lambda x: '{kind}:' || x.s || ':' || (x.s + length(x.v)))", f"list_transform({kind}, lambda x: '{kind}:' || x.s || ':' || format('{{:.2f}}', {base}e0 + CASE WHEN {near} THEN {CONTEXT}e0 ELSE 0e0 END))"))
    joined = lambda parts: f"array_to_string(list_concat({', '.join(parts)}), ',')"
    return f"""WITH source AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), raw AS (SELECT *, {", ".join(raw)} FROM source), found AS (SELECT doc_id, text, {", ".join(spans)} FROM raw)
    SELECT doc_id, {", ".join(f"CAST(len({k}) AS BIGINT) AS n_{k}" for k in BASE)}, sha256({joined([a for a, _ in out[:4]])}) AS base_sha256, {joined([a for a, _ in out])} AS spans, {joined([b for _, b in out])} AS scores FROM found"""


def quality_rules() -> str:
    """Counts and verdicts of the quality rules; doc_id must be a key."""
    p = MAX_REJECTION
    cdf = f"list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p}e0) + (n - i) * ln(1 - {p}e0))))"
    numbers = ", ".join(f"{number.replace(' / ', ' * 1e0 / ')} AS r_{rule}" for rule, (number, _) in RULES.items())
    first = ", ".join("CASE " + " ".join(f"WHEN r_{rule} > {cut}e0 THEN {step}" for step, (name, cut) in enumerate(PATH, 1) if name == rule) + " END" for rule in RULES)
    return rf"""WITH source AS (SELECT doc_id, coalesce(lang, 'und') AS stratum, coalesce(text, '') AS text FROM documents),
    split AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM source),
    windows AS (SELECT doc_id, unnest(range(1, len(words) - 6)) AS i, unnest(list_transform(range(1, len(words) - 6), lambda i: array_to_string(words[i:i + 7], ' '))) AS w FROM split),
    again AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1),
    covered AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM again, (SELECT unnest(range(8)) AS o) GROUP BY 1),
    counts AS (SELECT doc_id, stratum, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda w: length(w))), 0) AS BIGINT) AS word_chars,
      CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
      FROM split LEFT JOIN covered USING (doc_id)),
    numbers AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, {numbers} FROM counts),
    rated AS (SELECT *, least({first}) AS fails_at FROM numbers),
    held AS (SELECT * FROM rated WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
    strata AS (SELECT stratum FROM held GROUP BY stratum HAVING count(*) >= {least_tested()}),
    tested AS (SELECT stratum, step, count(*) AS n, count(*) FILTER (fails_at <= step) AS k FROM held JOIN strata USING (stratum), range(1, {len(PATH) + 1}) AS steps(step) GROUP BY stratum, step),
    failing AS (SELECT stratum, min(step) AS step FROM tested WHERE NOT {cdf} <= {LEVEL}e0 / (SELECT count(*) FROM strata) GROUP BY stratum),
    certified AS (SELECT stratum, CAST(coalesce(step - 1, {len(PATH)}) AS INT) AS certified FROM strata LEFT JOIN failing USING (stratum))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(fails_at <= certified, FALSE) AS kept, fails_at, coalesce(certified, 0) AS certified
    FROM rated LEFT JOIN certified USING (stratum)"""


def hard_negatives() -> str:
    """Anchors, positives and negatives by plain ranks over all scores."""
    return f"""WITH usable AS (SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS INT) AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
      FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (SELECT a.vec_id AS anchor_id, r.vec_id, r.label = a.label AS same, CAST(list_dot_product(a.e, r.e) AS BIGINT) AS score FROM usable a JOIN usable r ON a.vec_id % {EVERY} = 0 AND a.vec_id <> r.vec_id),
    positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES})
    SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
    FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND {LOW} * positive_score <= {WHOLE} * score AND {WHOLE} * score <= {WHOLE} * positive_score QUALIFY rank <= {NEGATIVES}"""


def _crc32(text: str) -> str:
    """crc32 of a short ASCII string, by its table of 256 entries worked out on the spot."""
    table = "list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END), i))"
    codes = f"list_transform(string_split({text}, ''), lambda c: CAST(ascii(c) AS BIGINT))"
    return f"xor(list_reduce({codes}, lambda c, b: xor(c >> 8, ({table})[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"


def merkle() -> str:
    """Trees as lists of a level's digests, reduced level by level; doc_id must be a key."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"
    head = " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars"))
    low = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    up = "list_transform(range((len(h) + 7) // 8), lambda i: sha256(array_to_string(h[i * 8 + 1 : i * 8 + 8], '')))"
    step = "array_to_string(h[r - r % 8 + 1 : r], '') || '/' || array_to_string(h[r + 2 : r - r % 8 + 8], '')"
    return f"""WITH RECURSIVE leaves AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, sha256({head} || {field("text")}) AS leaf, CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 3 = 0 AND text IS NOT NULL THEN sha256({head} || {field(low)}) END AS told FROM documents),
    placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY tree ORDER BY doc_id) - 1 AS BIGINT) AS r FROM leaves),
    up AS (SELECT tree, 0 AS level, list(leaf ORDER BY r) AS h FROM placed GROUP BY tree UNION ALL SELECT tree, level + 1, {up} FROM up WHERE len(h) > 1),
    subroots AS (SELECT tree, h[1] AS subroot, CAST(row_number() OVER (ORDER BY encode(tree)) - 1 AS BIGINT) AS r FROM up WHERE len(h) = 1),
    top AS (SELECT 0 AS level, list(subroot ORDER BY r) AS h FROM subroots UNION ALL SELECT level + 1, {up} FROM top WHERE len(h) > 1),
    ways AS (SELECT doc_id, level, {step.replace("r ", "(r // CAST(8 ** level AS BIGINT)) ").replace(": r]", ": (r // CAST(8 ** level AS BIGINT))]")} AS step FROM placed JOIN up USING (tree) WHERE len(h) > 1
      UNION ALL SELECT doc_id, 1000 + level, {step.replace("r ", "(s.r // CAST(8 ** level AS BIGINT)) ").replace(": r]", ": (s.r // CAST(8 ** level AS BIGINT))]")} FROM placed JOIN subroots s USING (tree), top WHERE len(h) > 1),
    steps AS (SELECT doc_id, list(step ORDER BY level) AS steps FROM ways GROUP BY doc_id),
    folded AS (SELECT doc_id, leaf, subroot, (SELECT h[1] FROM top WHERE len(h) = 1) AS root, sha256(replace(array_to_string(coalesce(steps, []), ''), '/', '')) AS proof_sha256,
      list_reduce(coalesce(steps, []), lambda h, s: sha256(replace(s, '/', h)), coalesce(told, leaf)) AS folded_root FROM placed JOIN subroots USING (tree) LEFT JOIN steps USING (doc_id))
    SELECT *, folded_root = root AS verified FROM folded"""


ORACLE = {"op3_quality_rules": quality_rules(), "op5_pii": pii(), "op11_hard_negatives": hard_negatives(), "op12_merkle_manifest": merkle()}
