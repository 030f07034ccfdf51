"""Scalar expressions over strings, arrays and flow columns (SQL text, so that
they fit ``F.expr``, ``selectExpr`` and SQL alike)."""

from __future__ import annotations

# RFC 1918 string prefixes and the known top-level domains.
INTERNAL = r"^(10\\.|172\\.(1[6-9]|2[0-9]|3[01])\\.|192\\.168\\.)"
KNOWN_TLDS = ("com", "net", "org", "gov", "edu", "io", "co", "uk", "de", "fr", "us", "ai", "dev", "app", "so", "me")


def is_internal(ip: str) -> str:
    return f"({ip} rlike '{INTERNAL}')"


def let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def entropy(a: str) -> str:
    """Shannon entropy in bits of an array's values, 0 if empty: the values are
    sorted once and their runs counted."""
    c_log = "if(s.c > 1, s.c * log2(s.c), 0D)"
    fold = (
        f"aggregate(slice(_e, 2, greatest(size(_e) - 1, 0)), named_struct('v', _e[0], 'c', 1D, 'h', 0D), "
        f"(s, x) -> if(x <=> s.v, named_struct('v', s.v, 'c', s.c + 1D, 'h', s.h), named_struct('v', x, 'c', 1D, 'h', s.h + {c_log})), s -> log2(size(_e)) - (s.h + {c_log}) / size(_e))"
    )
    return let("_e", f"array_sort({a})", f"CASE WHEN size(_e) > 0 THEN greatest({fold}, 0D) ELSE 0D END")


def char_entropy(s: str) -> str:
    return entropy(f"filter(split(lower({s}), ''), c -> c <> '')")


def interval_stats(us: str) -> str:
    """struct(mean, std) of the gaps in seconds of an array of micros; the
    population standard deviation; (0, 0) below two values. One sort, one pass."""
    mean = "if(size(_t) > 1, (_t[size(_t) - 1] - _t[0]) / 1e6D / (size(_t) - 1), 0D)"
    fold = "aggregate(_t, named_struct('t', _t[0], 'q', 0D), (s, x) -> named_struct('t', x, 'q', s.q + if(x IS NULL, 0D, power((x - s.t) / 1e6D - _m, 2))), s -> s.q)"
    # the first value differs from itself by 0, which is not a gap
    std = f"if(size(_t) > 1, sqrt(greatest(({fold} - power(_m, 2)) / (size(_t) - 1), 0D)), 0D)"
    return let("_t", f"array_sort({us})", let("_m", mean, f"named_struct('mean', _m, 'std', {std})"))


def mean_of(a: str) -> str:
    return f"CASE WHEN size({a}) > 0 THEN aggregate({a}, 0D, (s, x) -> s + x) / size({a}) ELSE 0D END"


def std_of(a: str) -> str:
    """Population standard deviation of an array, 0 below two values."""
    return let("_m", mean_of(a), f"CASE WHEN size({a}) > 1 THEN sqrt(aggregate({a}, 0D, (s, x) -> s + power(x - _m, 2)) / size({a})) ELSE 0D END")


def consonant_ratio(s: str) -> str:
    letters = f"regexp_replace(lower({s}), '[^\\\\p{{L}}]', '')"
    return f"CASE WHEN length({letters}) = 0 THEN 0D ELSE length(regexp_replace({letters}, '[aeiou]', '')) / length({letters}) END"


def numeric_ratio(s: str) -> str:
    return f"length(regexp_replace({s}, '[^0-9]', '')) / cast(greatest(length({s}), 1) AS double)"


def tld(q: str) -> str:
    return f"CASE WHEN instr({q}, '.') > 0 THEN element_at(split({q}, '\\\\.'), -1) ELSE '' END"


def tld_known(q: str) -> str:
    return f"{tld(q)} IN ({', '.join(repr(t) for t in KNOWN_TLDS)})"


def tunnel_ratio(query: str, answers: str) -> str:
    """struct(down, up, ratio, direction)."""
    q, a = f"length({query})", f"length({answers})"
    down, up = f"{a} / greatest({q}, 1)", f"{q} / greatest({a}, 1)"
    return f"named_struct('down', {down}, 'up', {up}, 'ratio', greatest({down}, {up}), 'direction', if({down} >= {up}, 'DOWNSTREAM', 'UPSTREAM'))"


def confidence(c: str) -> str:
    return f"round(least({c}, 0.99D), 2)"


def poisson_p(window: str, gap: str, samples: str) -> str:
    """Chance of an event within ``window`` at a mean gap; 1 below 3 samples."""
    return f"CASE WHEN {samples} < 3 THEN 1D ELSE -expm1(-({window}) / greatest({gap}, 1e-6)) END"


def adaptive_window(gap: str) -> str:
    return f"CASE WHEN {gap} IS NULL THEN 300D ELSE least(900D, greatest(60D, 3 * {gap})) END"
