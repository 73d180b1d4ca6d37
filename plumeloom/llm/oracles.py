"""SQL for the queries that SQL can express, over whole tables."""

from plumeloom.llm import fim, merkle, mixing, rules

_BLANK = r"[\x20\x09-\x0D]"
_WORDS = rf"list_filter(regexp_split_to_array(coalesce(text, ''), '{_BLANK}+'), lambda w: w <> '')"

_LEAF = merkle.LEAF.replace("{", "{{").replace("}", "}}")
_TREE = rf"""
{{n}}_l AS (SELECT doc_id, unnest(string_split({{t}}, chr(10))) AS line, generate_subscripts(string_split({{t}}, chr(10)), 1) AS i FROM {{of}}),
{{n}}_f AS (SELECT doc_id, i, list_transform(string_split(regexp_replace(line, '{_LEAF}', '\1' || chr(1), 'g'), chr(1)), lambda x: sha256(x)) AS f FROM {{n}}_l),
{{n}}_h AS (SELECT doc_id, i, f, sha256(array_to_string(f, '')) AS h FROM {{n}}_f),
{{n}}_e AS (SELECT doc_id, i, h, (right(h, 1) IN ('0', '8') OR h = '{merkle.EMPTY}')::INT AS ends FROM {{n}}_h),
{{n}}_s AS (SELECT doc_id, i, h, coalesce(sum(ends) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM {{n}}_e),
{{n}}_r AS (SELECT doc_id, sha256(string_agg(hs, '' ORDER BY s)) AS root FROM (SELECT doc_id, s, sha256(string_agg(h, '' ORDER BY i)) AS hs FROM {{n}}_s GROUP BY doc_id, s) GROUP BY doc_id),
{{n}}_c AS (SELECT doc_id, x, count(*) AS c FROM (SELECT doc_id, unnest(f) AS x FROM {{n}}_h) GROUP BY doc_id, x),
{{n}} AS (SELECT o.*, root, n FROM {{of}} o JOIN {{n}}_r USING (doc_id) JOIN (SELECT doc_id, sum(c)::BIGINT AS n FROM {{n}}_c GROUP BY doc_id) USING (doc_id))"""
_LIKE = "CASE WHEN {a}.root = {b}.root THEN 1.0::DOUBLE ELSE least(coalesce({k}.m, 0)::DOUBLE * 2.0::DOUBLE / ({a}.n + {b}.n)::DOUBLE, 1.0::DOUBLE - 1.0::DOUBLE / ({a}.n + {b}.n + 1)::DOUBLE) END"

OP5 = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, coalesce(lead(doc_id) OVER (ORDER BY doc_id), min(doc_id) OVER ()) AS nid FROM d),
e AS (SELECT n.doc_id, n.t, nid, left(n.t, length(n.t) - length(n.t) // 2) || left(x.t, length(n.t) // 2) AS et FROM n JOIN d x ON x.doc_id = nid),
{_TREE.format(n="own", t="t", of="e")}, {_TREE.format(n="edited", t="et", of="e")},
ke AS (SELECT a.doc_id, sum(least(a.c, b.c))::BIGINT AS m FROM own_c a JOIN edited_c b ON b.doc_id = a.doc_id AND b.x = a.x GROUP BY a.doc_id),
kn AS (SELECT a.doc_id, sum(least(a.c, b.c))::BIGINT AS m FROM own_c a JOIN e ON e.doc_id = a.doc_id JOIN own_c b ON b.doc_id = e.nid AND b.x = a.x GROUP BY a.doc_id),
fe AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, min(coalesce(a.i, b.i)) - 1 AS at FROM own_h a FULL JOIN edited_h b ON a.doc_id = b.doc_id AND a.i = b.i WHERE a.h IS DISTINCT FROM b.h GROUP BY 1)
SELECT a.doc_id, length(a.t)::BIGINT AS n_chars, sha256(a.et) AS edited_sha256, a.root AS fingerprint, b.root AS edited_fingerprint, {_LIKE.format(a="a", b="b", k="ke")} AS near_edited, {_LIKE.format(a="a", b="c", k="kn")} AS near_next, fe.at::BIGINT AS first_edit
FROM own a JOIN edited b USING (doc_id) JOIN own c ON c.doc_id = a.nid LEFT JOIN ke ON ke.doc_id = a.doc_id LEFT JOIN kn ON kn.doc_id = a.doc_id LEFT JOIN fe ON fe.doc_id = a.doc_id"""

_BITS = " | ".join(f"(CASE WHEN {r.fails} THEN {rules.BITS[r.name]} ELSE 0 END)" for r in rules.RULES)
OP7 = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
g AS (SELECT doc_id, i, w AS a, lead(w) OVER p AS b, lead(w, 2) OVER p AS c FROM w WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i FROM g WHERE c IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1),
k AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY doc_id),
l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(k.n, 0)::BIGINT AS n_repeat_words, (length(t) - length(replace(t, '!', '')))::BIGINT AS n_exclaims FROM l LEFT JOIN k USING (doc_id)),
b AS (SELECT *, ({_BITS})::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & {rules.mask_of("base-1")}) <> 0 AS base_failed, (fail_bits & {rules.mask_of(rules.PRODUCTION) | rules.mask_of("base-1")}) = 0 AS kept, fail_bits FROM b"""

OP9 = f"""WITH d AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size, ('0x' || substr(md5('{mixing.SEED}:' || doc_id), 1, {mixing.HASH_HEX}))::BIGINT AS u FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [{", ".join(map(str, mixing.WEIGHTS))}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1]::DOUBLE AS weight, (source_size * {mixing.MOST_REPEATS})::DOUBLE AS cap FROM s),
r AS (SELECT *, cap / weight AS ratio, (sum(source_size) OVER ())::DOUBLE * {float(mixing.BUDGET)}::DOUBLE - coalesce(sum(cap) OVER b, 0) AS rest, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS weights FROM w WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT arg_min(rest / weights, ratio) AS level FROM r WHERE rest / weights <= ratio),
t AS (SELECT source, source_size, least(cap, coalesce(level * weight, cap)) AS target FROM r, f),
q AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size) END::BIGINT AS base FROM t),
n AS (SELECT *, target - base * source_size AS need, CASE WHEN source_size = 0 THEN 0.0 ELSE (target - base * source_size) / source_size::DOUBLE END::DOUBLE AS fraction FROM q),
c AS (SELECT d.doc_id, d.size, d.u, n.*, sum(d.size) OVER (PARTITION BY n.source ORDER BY d.u) - d.size / 2.0::DOUBLE AS middle FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source)
SELECT doc_id, size, source_size, target, size * (base + (need > 0 AND middle <= need)::INT) AS taken, fraction, base + (u::DOUBLE < fraction * {float(1 << 4 * mixing.HASH_HEX)}::DOUBLE)::INT AS drawn FROM c"""

OP10 = rf"""WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_BLANK}+'), lambda w: w <> '') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
g AS (SELECT doc_id, w || ' ' || lead(w) OVER p || ' ' || lead(w, 2) OVER p || ' ' || lead(w, 3) OVER p || ' ' || lead(w, 4) OVER p AS g FROM w WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT DISTINCT doc_id, g FROM g WHERE g IS NOT NULL UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM d WHERE len(ws) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(a, b) AS (SELECT a, a FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b),
root AS (SELECT a AS doc_id, min(b) AS r FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(r, d.doc_id) AS component_id, coalesce(r, d.doc_id) = d.doc_id AS kept FROM d LEFT JOIN n USING (doc_id) LEFT JOIN root USING (doc_id)"""

_H = ", ".join(f"('0x' || substr(sha256('{fim.SEED}:' || doc_id), {1 + 8 * k}, 8))::BIGINT AS h{k + 1}" for k in range(4))
_MARKED = " OR ".join(f"contains(t, '{m}')" for m in fim.MARKS)
OP12 = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{fim.UNIT}') AS u, {_H} FROM documents),
f AS (SELECT doc_id, t, u, len(u)::BIGINT AS n, CASE WHEN t = '' OR {_MARKED} OR h3 % 100 >= {100 - fim.PLAIN} THEN 'plain' WHEN h4 % 100 < {fim.SPM} THEN 'spm' ELSE 'psm' END AS form, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b FROM d),
p AS (SELECT doc_id, t, n, form, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:n], '') AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{fim.PREFIX}' || prefix || '{fim.SUFFIX}' || suffix || '{fim.MIDDLE}' || middle ELSE '{fim.SUFFIX}' || suffix || '{fim.PREFIX}' || prefix || '{fim.MIDDLE}' || middle END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""

SQL = {"op5_document_fingerprints": OP5, "op7_quality_rules": OP7, "op9_mixing": OP9, "op10_minhash_near_dedup": OP10, "op12_fill_in_middle": OP12}
