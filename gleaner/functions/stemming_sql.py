"""The stemmer once more as SQL, a step a common table expression, for comparison over whole vocabularies."""

from __future__ import annotations

from gleaner.functions.stemming import IRREGULAR, STEP2, STEP3, STEP4


def _sound(e: str) -> str:
    """The word with every y that counts as a vowel written as i."""
    return f"regexp_replace(regexp_replace(regexp_replace({e}, '^yy', 'yi'), '([^aeiouy])y', '\\1i', 'g'), '([aeiou])yy', '\\1yi', 'g')"


def _measure(e: str) -> str:
    return f"len(regexp_extract_all({_sound(e)}, '[aeiou]+[^aeiou]+'))"


def _cut(e: str, n: int) -> str:
    return f"left({e}, length({e}) - {n})"


def _cvc(e: str) -> str:
    return f"(regexp_matches({_sound(e)}, '^[aeiou][^aeiou]$') OR (regexp_matches({_sound(e)}, '[^aeiou][aeiou][^aeiou]$') AND right({e}, 1) NOT IN ('w', 'x', 'y')))"


def _replaced(table) -> str:
    whens = " ".join(f"WHEN ends_with(w, '{s}') THEN CASE WHEN {_measure(_cut('w', len(s)))} > 0 THEN {_cut('w', len(s))} || '{new}' ELSE w END" for s, new in sorted(table, key=lambda x: -len(x[0])))
    return f"CASE {whens} ELSE w END"


def ctes(source: str, name: str = "sm") -> str:
    """``name(word, stem)`` of the distinct words of ``source(word)``, as a chain of table expressions."""
    known = ", ".join(f"('{a}', '{b}')" for a, b in IRREGULAR.items())
    double = f"(length(x) > 1 AND right(x, 1) = substring(x, length(x) - 1, 1) AND NOT regexp_matches({_sound('x')}, '[aeiou]$'))"
    stripped = " ".join(f"WHEN ends_with(w, '{s}') AND regexp_matches({_sound(_cut('w', len(s)))}, '[aeiou]') THEN {_cut('w', len(s))}" for s in ("ed", "ing"))
    dropped = " ".join(f"WHEN ends_with(w, '{s}') THEN CASE WHEN {_measure(_cut('w', len(s)))} > 1" + (f" AND right({_cut('w', 3)}, 1) IN ('s', 't')" if s == "ion" else "") + f" THEN {_cut('w', len(s))} ELSE w END" for s in sorted(STEP4, key=len, reverse=True))
    steps = [
        "CASE WHEN ends_with(w, 'ies') AND length(w) = 4 THEN left(w, 3) WHEN ends_with(w, 'sses') OR ends_with(w, 'ies') THEN " + _cut("w", 2) + " WHEN ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN " + _cut("w", 1) + " ELSE w END",
        None,  # past and progressive, below
        f"CASE WHEN ends_with(w, 'y') AND length(w) > 2 AND substring({_sound('w')}, length(w) - 1, 1) NOT IN ('a', 'e', 'i', 'o', 'u') THEN {_cut('w', 1)} || 'i' ELSE w END",
        f"CASE WHEN ends_with(w, 'alli') AND {_measure(_cut('w', 4))} > 0 THEN {_cut('w', 4)} || 'al' ELSE w END",
        _replaced(STEP2),
        f"CASE WHEN ends_with(w, 'logi') AND {_measure(_cut('w', 3))} > 0 THEN {_cut('w', 1)} ELSE w END",
        _replaced(STEP3),
        f"CASE {dropped} ELSE w END",
        f"CASE WHEN ends_with(w, 'e') AND ({_measure(_cut('w', 1))} > 1 OR ({_measure(_cut('w', 1))} = 1 AND NOT {_cvc(_cut('w', 1))})) THEN {_cut('w', 1)} ELSE w END",
        f"CASE WHEN ends_with(w, 'll') AND {_measure(_cut('w', 1))} > 1 THEN {_cut('w', 1)} ELSE w END",
    ]
    out = [f"{name}0 AS (SELECT DISTINCT word, word AS w FROM {source} WHERE length(word) > 2 AND word NOT IN (SELECT a FROM (VALUES {known}) i(a, b)))"]
    for k, step in enumerate(steps):
        if step is None:
            out.append(f"{name}x AS (SELECT word, w, CASE WHEN ends_with(w, 'ied') OR ends_with(w, 'eed') THEN NULL {stripped} END AS x FROM {name}{k})")
            past = f"CASE WHEN x IS NOT NULL THEN CASE WHEN right(x, 2) IN ('at', 'bl', 'iz') THEN x || 'e' WHEN {double} THEN CASE WHEN right(x, 1) IN ('l', 's', 'z') THEN x ELSE {_cut('x', 1)} END WHEN {_measure('x')} = 1 AND {_cvc('x')} THEN x || 'e' ELSE x END WHEN ends_with(w, 'ied') THEN CASE WHEN length(w) = 4 THEN {_cut('w', 1)} ELSE {_cut('w', 2)} END WHEN ends_with(w, 'eed') AND {_measure(_cut('w', 3))} > 0 THEN {_cut('w', 1)} ELSE w END"
            out.append(f"{name}{k + 1} AS (SELECT word, {past} AS w FROM {name}x)")
        else:
            out.append(f"{name}{k + 1} AS MATERIALIZED (SELECT word, {step} AS w FROM {name}{k})")
    out.append(f"{name} AS MATERIALIZED (SELECT word, w AS stem FROM {name}{len(steps)} UNION ALL SELECT DISTINCT word, coalesce(b, word) FROM {source} LEFT JOIN (VALUES {known}) i(a, b) ON word = a WHERE a IS NOT NULL OR length(word) <= 2)")
    return ",\n".join(out)
