"""DuckDB SQL for the queries of this folder that SQL can express."""

from __future__ import annotations

from itertools import permutations

from kerbline.llm import filter_audit as filter_audit_module
from kerbline.llm import url_filter

EXACT_DEDUP = r"""
WITH normalised AS (
    SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS text FROM documents
), grouped AS (
    SELECT text, min(doc_id) AS keep_id, count(*) AS group_size FROM normalised GROUP BY text
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(text) AS text_sha256
FROM normalised JOIN grouped USING (text)
"""

_TWO = ", ".join(f"'{suffix}'" for suffix in url_filter.TWO_LABEL_SUFFIXES)
_LOW, _HIGH = url_filter.CORRELATION


def _strength(children: str) -> str:
    """The prior's pseudo-counts, from ``bad``, ``pages`` and ``mean`` of the rows of ``children``."""
    return f"""(SELECT coalesce(1 / greatest(least(CASE WHEN noise > 0 THEN (spread - chance) / noise ELSE 0.0 END, {_HIGH}), {_LOW}) - 1,
        1 / CAST({_LOW} AS double) - 1)
    FROM (SELECT sum(mean * (1 - mean)) AS chance, sum(pages * pow(bad / pages - mean, 2)) AS spread,
        sum(pages * mean * (1 - mean)) - sum(mean * (1 - mean)) AS noise FROM {children}))"""


def _rule_cases(rules: list[url_filter.Rule], value: str) -> str:
    cases = [
        f"WHEN (host = '{rule.host}' OR ends_with(host, '.{rule.host}')) AND starts_with(path, '{rule.path}')"
        f" THEN '{getattr(rule, value)}'"
        for rule in sorted(rules, key=lambda rule: -len(rule.text))
    ]
    return "CASE " + " ".join(cases) + " END"


def url_verdicts(rules: list[url_filter.Rule]) -> str:
    return rf"""
WITH parts AS (
    SELECT page_id,
        translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), '{url_filter.UPPER}', '{url_filter.LOWER}') AS host,
        coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
    FROM pages
), named AS (
    SELECT *, TRY_CAST(regexp_extract(path, '/([0-9]{{1,18}})(?:\.html|/)?$', 1) AS bigint) AS doc_id,
        string_split(host, '.') AS labels
    FROM parts
), hosts AS (
    SELECT DISTINCT host,
        CASE WHEN regexp_matches(host, '^[0-9.]+$') THEN host
            WHEN array_to_string(labels[-2:], '.') IN ({_TWO}) THEN array_to_string(labels[-3:], '.')
            ELSE array_to_string(labels[-2:], '.') END AS domain,
        CASE WHEN regexp_matches(host, '^[0-9.]+$') THEN host
            WHEN array_to_string(labels[-2:], '.') IN ({_TWO}) THEN array_to_string(labels[-2:], '.')
            ELSE labels[-1] END AS suffix
    FROM named
), counted AS (
    SELECT host, CAST(sum(greatest(1 - quality, toxic)) AS double) AS bad, count(greatest(1 - quality, toxic)) AS pages
    FROM named JOIN labels USING (doc_id) GROUP BY host HAVING count(greatest(1 - quality, toxic)) > 0
), by_host AS (
    SELECT * FROM counted JOIN hosts USING (host)
), overall AS (
    SELECT coalesce(sum(bad) / sum(pages), 0.0) AS mean FROM by_host
), suffix_counts AS (
    SELECT suffix, sum(bad) AS bad, sum(pages) AS pages, any_value(mean) AS mean FROM by_host, overall GROUP BY suffix
), suffixes AS (
    SELECT suffix, (bad + m * mean) / (pages + m) AS suffix_mean FROM suffix_counts, (SELECT {_strength("suffix_counts")} AS m)
), domain_counts AS (
    SELECT domain, suffix, sum(bad) AS bad, sum(pages) AS pages, any_value(suffix_mean) AS mean
    FROM by_host JOIN suffixes USING (suffix) GROUP BY domain, suffix
), domains AS (
    SELECT domain, (bad + m * mean) / (pages + m) AS domain_mean FROM domain_counts, (SELECT {_strength("domain_counts")} AS m)
), host_counts AS (
    SELECT by_host.*, domain_mean AS mean FROM by_host JOIN domains USING (domain)
), posteriors AS (
    SELECT hosts.host, coalesce(bad, 0) + m * coalesce(domain_mean, suffix_mean, overall.mean) AS alpha,
        coalesce(pages, 0) - coalesce(bad, 0) + m * (1 - coalesce(domain_mean, suffix_mean, overall.mean)) AS beta
    FROM hosts LEFT JOIN counted USING (host) LEFT JOIN domains USING (domain) LEFT JOIN suffixes USING (suffix),
        overall, (SELECT {_strength("host_counts")} AS m)
), reputations AS (
    SELECT host, CASE WHEN alpha / (alpha + beta)
        - {url_filter.BOUND_DEVIATIONS} * sqrt(alpha * beta / ((alpha + beta) * (alpha + beta) * (alpha + beta + 1))) > {url_filter.BLOCK_SHARE}
        THEN 'block' ELSE 'allow' END AS reputation
    FROM posteriors
)
SELECT page_id, host, path, {_rule_cases(rules, "text")} AS rule, coalesce({_rule_cases(rules, "verdict")}, reputation) AS verdict
FROM parts JOIN reputations USING (host)
"""


# ---- near-duplicates by similarity --------------------------------------------------------------


def near_duplicates(words: int, similarity: tuple[int, int]) -> str:
    """Every pair of documents that share a shingle, by the full sets of their shingles."""
    part, whole = similarity
    span = f"least({words}, len(words))"
    return rf"""
WITH RECURSIVE worded AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{url_filter.UPPER}', '{url_filter.LOWER}'), '[^ 	-
]+') AS words
    FROM documents
), sets AS MATERIALIZED (
    SELECT doc_id, list_distinct(list_transform(range(1, len(words) - {span} + 2), lambda i: array_to_string(words[i:i + {span} - 1], ' '))) AS shingles
    FROM worded WHERE len(words) > 0
), entries AS MATERIALIZED (
    SELECT doc_id, len(shingles) AS size, unnest(shingles) AS shingle FROM sets
), links AS MATERIALIZED (
    SELECT a.doc_id AS a, b.doc_id AS b
    FROM entries a JOIN entries b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
        AND {part} * a.size <= {whole} * b.size AND {part} * b.size <= {whole} * a.size
    GROUP BY a.doc_id, b.doc_id, a.size, b.size HAVING {whole} * count(*) >= {part} * (a.size + b.size - count(*))
), reached AS (
    SELECT doc_id AS node, doc_id AS low FROM documents
    UNION
    SELECT b, low FROM reached JOIN links ON a = node WHERE low < b
)
SELECT doc_id, CAST(coalesce(len(shingles), 0) AS bigint) AS n_shingles, min(low) AS component_id, doc_id = min(low) AS kept
FROM documents LEFT JOIN sets USING (doc_id) JOIN reached ON node = doc_id GROUP BY doc_id, shingles
"""


# ---- filter interaction audit -------------------------------------------------------------------


def filter_audit() -> str:
    """Every order applied step by step to failure masks counted by part."""
    letters = filter_audit_module.LETTERS
    values = ", ".join(
        f"('{''.join(order)}', {step}, {sum(1 << letters.index(c) for c in order[: step - 1])}, {1 << letters.index(order[step - 1])})"
        for order in permutations(letters)
        for step in range(1, len(letters) + 1)
    )
    return rf"""
WITH texts AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents
), worded AS (
    SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
        length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS capitals,
        min(doc_id) OVER (PARTITION BY text) AS first_id
    FROM texts
), masked AS (
    SELECT part, doc_id,
        CAST(len(words) < {filter_audit_module.MIN_WORDS} AS integer)
        + 2 * CAST(100 * len(list_distinct(words)) < {filter_audit_module.DISTINCT_PERCENT} * len(words) AS integer)
        + 4 * CAST(100 * capitals > {filter_audit_module.UPPER_PERCENT} * length(text) AS integer)
        + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS integer)
        + 16 * CAST(first_id IS NOT NULL AND (doc_id IS NULL OR doc_id > first_id) AS integer) AS mask
    FROM worded
), flags AS (
    SELECT doc_id, max(CAST(coalesce(quality = 1, false) AS integer)) AS good, max(CAST(coalesce(toxic = 1, false) AS integer)) AS toxic
    FROM labels GROUP BY doc_id
), counts AS (
    SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
    FROM masked LEFT JOIN flags USING (doc_id) GROUP BY part, mask
), orders AS (
    SELECT * FROM (VALUES {values}) AS t(filter_order, step, state, own)
), steps AS (
    SELECT part, filter_order, step, own,
        CAST(coalesce(sum(n) FILTER (mask & (state | own) = 0), 0) AS bigint) AS kept,
        CAST(coalesce(sum(n) FILTER (mask & state = 0 AND mask & own <> 0), 0) AS bigint) AS removed,
        CAST(coalesce(sum(n) FILTER (mask & state <> 0 AND mask & own <> 0), 0) AS bigint) AS redundant,
        CAST(coalesce(sum(n) FILTER (mask = own), 0) AS bigint) AS unique_fails,
        CAST(coalesce(sum(good) FILTER (mask & state = 0 AND mask & own <> 0), 0) AS bigint) AS good_lost,
        CAST(coalesce(sum(toxic) FILTER (mask & state = 0 AND mask & own <> 0), 0) AS bigint) AS toxic_lost
    FROM counts, orders GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    CAST(sum(removed) OVER (PARTITION BY part, own) AS bigint) AS shapley
FROM steps
"""


# ---- Merkle manifest ----------------------------------------------------------------------------

#: Levels of a group's tree and of the tree above that the twin is written out for.
GROUP_LEVELS, TOP_LEVELS = 8, 4


def _crc32(text: str) -> str:
    """Unsigned CRC-32 of ASCII text, byte by byte and bit by bit."""
    halved = "list_reduce(list_prepend(xor(c, b), CAST(range(8) AS ubigint[])), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::ubigint) ELSE v >> 1 END)"
    codes = f"list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS ubigint))"
    return f"xor(list_reduce(list_prepend(4294967295::ubigint, {codes}), lambda c, b: {halved}), 4294967295::ubigint)"


def _encoded(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS varchar)) || ':' || CAST({value} AS varchar), '-')"


def merkle_manifest(arity: int) -> str:
    def levels(prefix: str, count: int) -> str:
        """Tables of nodes and of runs, level by level; a tree of one node stays as it is."""
        made = []
        for k in range(count):
            made.append(f"{prefix}_runs{k} AS (SELECT g, idx // {arity} AS run, n, list(h ORDER BY idx) AS hs FROM {prefix}{k} GROUP BY ALL)")
            made.append(
                f"{prefix}{k + 1} AS (SELECT g, run AS idx, CASE WHEN n > 1 THEN (n + {arity - 1}) // {arity} ELSE n END AS n,"
                f" CASE WHEN n > 1 THEN sha256(array_to_string(hs, '')) ELSE hs[1] END AS h FROM {prefix}_runs{k})"
            )
        return ", ".join(made)

    def climbs(prefix: str, first: int, count: int, at: str) -> str:
        """The way of each document up a tree: what its siblings are and what its own branch folds to."""
        made = []
        for k in range(count):
            place = f"(p.{at} // {arity**k}) % {arity}"
            before, after = f"array_to_string(hs[:{place}], '')", f"array_to_string(hs[{place} + 2:], '')"
            tree = "p.g" if prefix == "n" else "0"
            made.append(
                f"p{first + k + 1} AS (SELECT p.* REPLACE (CASE WHEN n > 1 THEN proof || {before} || {after} ELSE proof END AS proof,"
                f" CASE WHEN n > 1 THEN sha256({before} || folded || {after}) ELSE folded END AS folded)"
                f" FROM p{first + k} p JOIN {prefix}_runs{k} r ON r.g = {tree} AND r.run = p.{at} // {arity ** (k + 1)})"
            )
        return ", ".join(made)

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(_encoded(v) for v in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    lowered = f"translate(text, '{url_filter.UPPER}', '{url_filter.LOWER}')"
    return f"""
WITH hashed AS (
    SELECT doc_id, lang, {leaf("text")} AS leaf,
        CASE WHEN {_crc32("CAST(doc_id AS varchar)")} % 3 = 0 THEN {leaf(lowered)} ELSE {leaf("text")} END AS given
    FROM documents
), placed AS (
    SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g,
        row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
    FROM hashed
), n0 AS (
    SELECT g, pos AS idx, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM placed
), {levels("n", GROUP_LEVELS)}, t0 AS (
    SELECT 0 AS g, g AS idx, h, count(*) OVER () AS n FROM n{GROUP_LEVELS}
), {levels("t", TOP_LEVELS)}, p0 AS (
    SELECT doc_id, leaf, g, pos, '' AS proof, given AS folded FROM placed
), {climbs("n", 0, GROUP_LEVELS, "pos")}, {climbs("t", GROUP_LEVELS, TOP_LEVELS, "g")}
SELECT doc_id, leaf, s.h AS subroot, r.h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = r.h AS verified
FROM p{GROUP_LEVELS + TOP_LEVELS} p JOIN n{GROUP_LEVELS} s USING (g), t{TOP_LEVELS} r
"""
