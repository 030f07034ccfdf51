"""DuckDB twins of the corpus queries that SQL can express."""

from __future__ import annotations

from flowdetect.llm import quality as q

_SPLIT = r"list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def _op1() -> str:
    n = len(q.CLASSES)
    own = ", ".join(f"len(regexp_replace(j, '[^{c}]+', '', 'g')) AS _c_{k}" for k, c in (("lower", "a-z"), ("upper", "A-Z"), ("digit", "0-9")))
    words = ", ".join(f"len(list_filter(w, lambda x: x = '{v}' OR x = '{v.capitalize()}')) AS _w_{v}" for v in q.vocabulary(q.COMMON))
    sums, chars, dists = [], [], []

    def js(pairs, p_all, q_all):
        terms = []
        for p, r in pairs:
            p, r = f"(1e0 * ({p}) / ({p_all}))", f"(1e0 * ({r}) / ({q_all}))"
            terms += [f"CASE WHEN {a} > 0 THEN {a} * ln(2 * {a} / ({p} + {r})) ELSE 0e0 END" for a in (p, r)]
        return f"CASE WHEN ({p_all}) > 0 AND ({q_all}) > 0 THEN sqrt(greatest(0e0, ({' + '.join(terms)}) / (2 * ln(2e0)))) END"

    for lang, common in q.COMMON.items():
        cols = [f"_c_{c}" for c in q.CLASSES] + [f"_w_{w}" for w in common] + ["n_words"]
        sums += [f"coalesce(sum({c}) FILTER (lang = '{lang}'), 0) AS r{lang}{k}" for k, c in enumerate(cols)]
        ref = [f"r{lang}{k}" for k in range(len(cols))]
        chars.append(js(list(zip(cols[:n], ref[:n])), " + ".join(cols[:n]), " + ".join(ref[:n])))
        rest = (f"n_words - ({' + '.join(cols[n:-1])})", f"{ref[-1]} - ({' + '.join(ref[n:-1])})")
        dists.append(js([*zip(cols[n:-1], ref[n:-1]), rest], "n_words", ref[-1]))
    base = "(n_words < 10 OR n_repeat_words > 0.2 * n_words)"
    far = "((word_chars >= 200 AND coalesce(char_distance, 0) > 0.25) OR (n_words >= 100 AND coalesce(word_distance, 0) > 0.27))"
    kept = f"(NOT {base} AND NOT ((lang IS NULL OR lang IN ('en', 'de', 'fr', 'es')) AND {far}))"
    return rf"""
WITH t AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, {_SPLIT} AS w, regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g') AS j FROM t),
f AS (SELECT doc_id, i, list_slice(w, i, i + 4) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
h AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM f) WHERE n > 1),
r AS (SELECT doc_id, sum(least(5, coalesce(nx - i, 5)))::BIGINT AS n FROM (SELECT *, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM h) GROUP BY doc_id),
l AS (SELECT doc_id, (count(*) - count(DISTINCT line))::BIGINT AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
s AS (SELECT w.doc_id, lang, len(w)::BIGINT AS n_words, len(j)::BIGINT AS word_chars, len(regexp_replace(j, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
  coalesce(l.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, {own}, len(t) - len(j) AS _c_space, len(regexp_replace(j, '[\x00-\x7F]+', '', 'g')) AS _c_wide, {words}
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id LEFT JOIN r ON w.doc_id = r.doc_id),
p AS (SELECT *, len0 - _c_lower - _c_upper - _c_digit - _c_wide AS _c_punct FROM (SELECT *, word_chars AS len0 FROM s)),
x AS (SELECT {', '.join(sums)} FROM p),
d AS (SELECT p.*, round(least({', '.join(chars)}), 6) AS char_distance, round(least({', '.join(dists)}), 6) AS word_distance FROM p, x)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, char_distance, word_distance, {base} AS base_failed, {kept} AS kept FROM d"""


OP1 = _op1()


OP3 = r"""
WITH d AS (SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size,
  md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
p AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
q AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1] AS weight, 2 * source_size AS cap FROM p),
r AS (SELECT *, sum(source_size) OVER () * 150 - 100 * coalesce(sum(cap) OVER b, 0) AS lft, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS opn
  FROM q WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s AS (SELECT *, weight * lft > 100 * cap * opn AS ful FROM r),
t AS (SELECT source, source_size, CASE WHEN ful THEN cap::DOUBLE ELSE (weight * (SELECT arg_min(lft, cap / weight) FROM s WHERE NOT ful))::DOUBLE / (100.0::DOUBLE * (SELECT arg_min(opn, cap / weight) FROM s WHERE NOT ful)) END AS target FROM s),
u AS (SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS whole,
  coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * least(whole + (before + size / 2.0 <= target - whole * source_size)::INT, 2))::BIGINT AS taken FROM u"""


OP4 = r"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
p AS (SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
x(h, q, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (SELECT page_id, arg_max(h || q, len(h) * 1000 + len(q)) AS rule, arg_max(verdict, len(h) * 1000 + len(q)) AS verdict
  FROM p JOIN x ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY page_id)
SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)"""


def _op8() -> str:
    # the whole lexicon; four quarters; eight of 16, of 64 and of 256 parts
    members, first = [], 0
    for digit, (rate, n) in (("h", (1, 1)), ("h // 1000", (4, 4)), ("h // 1000000", (16, 8)), ("h // 1000000000", (64, 8)), ("h // 1000000000000", (256, 8))):
        members.append(f"CASE WHEN ({digit}) % {rate} < {n} THEN {first} + ({digit}) % {rate} END")
        first += n
    n = first
    near = "CASE WHEN count(*) FILTER ({a} <> '' OR {b} <> '') = 0 THEN max(CASE WHEN {same} THEN 1e0 ELSE 0e0 END) ELSE count(*) FILTER ({a} <> '' AND {a} = {b}) / (count(*) FILTER ({a} <> '' OR {b} <> ''))::DOUBLE END"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
o AS (SELECT *, len(t) AS n, coalesce(lead(t) OVER w, first_value(t) OVER w) AS nt, coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS nid FROM d WINDOW w AS (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
e AS (SELECT *, substr(t, 1, n - n // 2) || substr(nt, 1, n // 2) AS ed FROM o),
w AS (SELECT doc_id, 0 AS tag, unnest(list_distinct(list_filter(regexp_split_to_array(lower(t), '[\x20\x09-\x0D]+'), lambda x: x <> ''))) AS term FROM e
  UNION ALL SELECT doc_id, 1, unnest(list_distinct(list_filter(regexp_split_to_array(lower(ed), '[\x20\x09-\x0D]+'), lambda x: x <> ''))) FROM e),
x AS (SELECT term, ('0x' || substr(md5(term), 1, 15))::BIGINT AS h FROM w WHERE tag = 0 GROUP BY term HAVING count(*) >= greatest(2, 0.001 * (SELECT count(*) FROM d)) AND count(*) <= 0.1 * (SELECT count(*) FROM d)),
m AS (SELECT doc_id, tag, h, unnest([{', '.join(members)}]) AS s FROM w JOIN x USING (term)),
g AS (SELECT doc_id, tag, s, substr(md5(string_agg(h, ',' ORDER BY h)), 1, 8) AS f FROM m WHERE s IS NOT NULL GROUP BY ALL),
a AS (SELECT e.doc_id, i.s, coalesce(g0.f, '') AS own, coalesce(g1.f, '') AS edf, coalesce(g2.f, '') AS nxt, t = ed AS same_ed, t = nt AS same_nt FROM e CROSS JOIN range(0, {n}) i(s)
  LEFT JOIN g g0 ON g0.doc_id = e.doc_id AND g0.s = i.s AND g0.tag = 0 LEFT JOIN g g1 ON g1.doc_id = e.doc_id AND g1.s = i.s AND g1.tag = 1 LEFT JOIN g g2 ON g2.doc_id = e.nid AND g2.s = i.s AND g2.tag = 0),
f AS (SELECT doc_id, string_agg(CASE own WHEN '' THEN '-' ELSE own END, '' ORDER BY s) AS fingerprint, string_agg(CASE edf WHEN '' THEN '-' ELSE edf END, '' ORDER BY s) AS edited_fingerprint,
  {near.format(a='own', b='edf', same='same_ed')} AS near_edited, {near.format(a='own', b='nxt', same='same_nt')} AS near_next FROM a GROUP BY doc_id)
SELECT e.doc_id, n::BIGINT AS n_chars, sha256(ed) AS edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next FROM e JOIN f USING (doc_id)"""


OP8 = _op8()


# Every 200-byte string of every text; those that occur twice remove the bytes
# they cover.
OP6 = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS x FROM documents),
p AS (SELECT doc_id, i, md5_number(x[i + 1 : i + 200]) AS h FROM (SELECT doc_id, x, unnest(range(0, octet_length(x) - 199)) AS i FROM d WHERE octet_length(x) >= 200)),
t AS (SELECT doc_id, i FROM p WHERE h IN (SELECT h FROM p GROUP BY h HAVING count(*) > 1)),
g AS (SELECT doc_id, i, i > coalesce(max(i + 200) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS fresh FROM t),
r AS (SELECT doc_id, i, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
s AS (SELECT doc_id, run, min(i) AS a, max(i) + 200 AS b FROM r GROUP BY doc_id, run),
k AS (SELECT s.doc_id, run, b - a AS n, hex(x[coalesce(lag(b) OVER w, 0) + 1 : a]) AS before, hex(x[b + 1 : octet_length(x)]) AS rest, row_number() OVER (PARTITION BY s.doc_id ORDER BY a DESC) AS back
  FROM s JOIN d ON s.doc_id = d.doc_id WINDOW w AS (PARTITION BY s.doc_id ORDER BY a)),
c AS (SELECT doc_id, sum(n)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(before, '' ORDER BY run) || max(CASE WHEN back = 1 THEN rest END) AS kept FROM k GROUP BY doc_id)
SELECT d.doc_id, octet_length(x)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(coalesce(unhex(kept), x)) AS kept_sha256 FROM d LEFT JOIN c ON d.doc_id = c.doc_id"""


# All shingle sets, all links by an equi-join on the shingle, components by
# following links.
OP7 = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5_number(array_to_string(CASE WHEN len(w) < 4 THEN w ELSE w[i : i + 3] END, ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
b AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_ FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM b JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * both_ >= 85 * (p.n + q.n - both_)),
r AS (SELECT DISTINCT a AS doc_id, a AS root FROM l UNION SELECT l.b, r.root FROM r JOIN l ON r.doc_id = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.root, d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id) c USING (doc_id)"""
