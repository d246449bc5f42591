"""The corpus queries as SQL for DuckDB, written independently of the operators' plans."""

from __future__ import annotations

from quantloom.llm.licenses import (
    ALL_RULES,
    COPYRIGHT,
    EXCEPTION,
    EXPRESSION,
    JOINT,
    KEYWORDS,
    MORE_SENTENCES,
    NO_COPYRIGHT,
    OPENINGS,
    SENTENCES,
    TAG,
    TAGS,
    UNCUT,
)

_WORDS = r"""list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '')"""

#: CRC-32 by its table: of `w`, whose bytes are read from the hexadecimal digits of its UTF-8 form.
_CRC_TABLE = """crc_table AS (
  SELECT list(list_reduce([i] || [0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT i FROM range(256) AS r(i)))"""
_CRC = """xor(list_reduce([4294967295] || list_transform(range(1, 2 * strlen(w), 2), lambda i: ('0x' || substr(hex(encode(w)), i, 2))::BIGINT),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"""

#: Word and pair counts in hashed buckets, trusted (without the judged text) against all, and the base counts by plain relations.
OP2 = rf"""
WITH {_CRC_TABLE},
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
word AS (SELECT r, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM docs),
spelt AS (SELECT w, {_CRC} % 65536 AS h FROM (SELECT DISTINCT w FROM word), crc_table),
tongue AS (SELECT w AS lang, {_CRC} % 4096 AS tongue FROM (SELECT DISTINCT lang AS w FROM docs), crc_table),
paired AS (
  SELECT r, i, word.w, h, lead(h) OVER p AS h2, lead(word.w, 1) OVER p AS w2, lead(word.w, 2) OVER p AS w3
  FROM word JOIN spelt USING (w) WINDOW p AS (PARTITION BY r ORDER BY i)),
gram AS (SELECT r, h AS b FROM paired UNION ALL SELECT r, (h * 31 + h2) % 65536 + 65536 FROM paired WHERE h2 IS NOT NULL),
trusted AS (SELECT DISTINCT r FROM docs JOIN labels USING (doc_id) WHERE quality = 1),
own AS (SELECT r, b, count(*) AS c, t.r IS NOT NULL AS is_target FROM gram LEFT JOIN trusted t USING (r) GROUP BY ALL),
counted AS (SELECT b, sum(c) AS raw, coalesce(sum(c) FILTER (is_target), 0) AS target FROM own GROUP BY b),
total AS (SELECT coalesce(sum(raw), 0)::DOUBLE AS raw, coalesce(sum(target), 0)::DOUBLE AS target FROM counted),
length AS (SELECT r, sum(c) AS n FROM own GROUP BY r),
weight AS (SELECT b, c.raw, c.target, ln((c.target / greatest(t.target, 1) * t.raw / c.raw + 0.1) / 1.1) AS v FROM counted c, total t),
means AS (
  SELECT tongue, sum(c * v) / sum(c) AS mean
  FROM own JOIN weight USING (b) JOIN docs USING (r) JOIN tongue USING (lang) GROUP BY tongue),
ratio AS (
  SELECT r, sum(c * CASE WHEN is_target THEN ln(((w.target - c) / greatest(t.target - n, 1) * t.raw / w.raw + 0.1) / 1.1) ELSE v END) / any_value(n) AS ratio
  FROM own JOIN weight w USING (b) JOIN length USING (r), total t GROUP BY r),
window3 AS (SELECT r, i, count(*) OVER (PARTITION BY r, w, w2, w3) AS n FROM paired WHERE w3 IS NOT NULL),
repeated AS (
  SELECT r, count(DISTINCT i + k) AS n FROM window3, (VALUES (0), (1), (2)) AS step(k) WHERE n > 1 GROUP BY r),
line AS (SELECT r, unnest(string_split(text, chr(10))) AS l FROM docs),
dup AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM line WHERE regexp_matches(l, '[^ \t-\r]') GROUP BY r),
base AS (
  SELECT docs.r, doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[ \t-\r]', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(repeated.n, 0)::BIGINT AS n_repeat_words, coalesce(ratio - mean, 0) AS ratio
  FROM docs JOIN tongue USING (lang) LEFT JOIN dup USING (r) LEFT JOIN repeated USING (r) LEFT JOIN ratio USING (r) LEFT JOIN means USING (tongue)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(ratio, 6) + 0.0 AS ratio,
  NOT base_failed AND ratio >= -0.25 AS kept
FROM judged
"""

_QUINTET = "('0x' || substr(h, {at}, 5))::INT"
_ALPHABET = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
_BASE32 = " || ".join(
    f"substr({_ALPHABET}, 1 + (({_QUINTET.format(at=1 + 5 * g)} >> {shift}) & 31), 1)" for g in range(8) for shift in (15, 10, 5, 0)
)

OP3 = f"""
WITH page AS (SELECT page_id, coalesce(html, '') AS p FROM pages),
first AS (SELECT p, min(page_id) AS first_page FROM page GROUP BY p),
hashed AS (SELECT page_id, p, sha1(p) AS h, page_id IS DISTINCT FROM first_page AS again, first_page FROM page JOIN first USING (p))
SELECT page_id, strlen(p)::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first_page END AS refers_to
FROM hashed
"""

#: All pairs that share a shingle, then the smallest id along the links.
OP4 = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda x: x <> '') AS w
  FROM documents),
shingled AS (
  SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
  FROM docs),
sized AS (SELECT doc_id, s, len(s)::BIGINT AS n FROM shingled),
shingle AS (SELECT doc_id, n, unnest(s) AS t FROM sized),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny, count(*) AS c
  FROM shingle a JOIN shingle b ON a.t = b.t AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY ALL),
link AS (SELECT x, y FROM common WHERE 100 * c >= 90 * (nx + ny - c)),
reach(id, c) AS (SELECT doc_id, doc_id FROM sized UNION SELECT link.y, reach.c FROM reach JOIN link ON link.x = reach.id WHERE reach.c < link.y),
links AS (SELECT x, count(*) AS k FROM link GROUP BY x)
SELECT doc_id, any_value(n) AS n_shingles, min(c) AS component_id, coalesce(any_value(k), 0)::BIGINT AS n_links
FROM sized JOIN reach ON id = doc_id LEFT JOIN links ON x = doc_id GROUP BY doc_id
"""

_IDENTIFIER = "CASE " + " ".join(f"WHEN regexp_full_match({{s}}, '(?:{p})') THEN '{i}'" for i, p in SENTENCES + MORE_SENTENCES) + " ELSE 'unknown' END"
_RULE_ROWS = ", ".join(
    f"({k}, '{name}', '{''.join(f'<{i}>' for i in ids)}')" for k, (name, ids) in enumerate(ALL_RULES, start=1)
)
_NORMAL = "trim(regexp_replace(lower({s}), '[^a-z0-9]+', ' ', 'g'))"
_UNCUT = "coalesce(text, '')"
for _pattern, _form in UNCUT:
    _UNCUT = f"regexp_replace({_UNCUT}, '{_pattern}', '{_form.format('', chr(92) + '1', chr(92) + '2')}', 'g')"
_TAGS = ", ".join(f"'{name}'" for name in TAGS)

#: Pieces as rows, sentences as runs of pieces, each named as a whole or piece by piece.
OP6 = rf"""
WITH RECURSIVE cut AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(regexp_replace({_UNCUT}, '([.!?;:])[ \t]+', '\1' || chr(10), 'g'), chr(10)) AS ss
  FROM documents),
piece AS (SELECT r, unnest(ss) AS p, generate_subscripts(ss, 1) AS i FROM cut),
beside AS (SELECT *, lag(p) OVER (PARTITION BY r ORDER BY i) AS before, {_NORMAL.format(s="p")} AS plain FROM piece),
begun AS (
  SELECT *, before IS NULL OR regexp_matches(before, '[.!?;:]["'')\]]*[ \t\r]*$') OR NOT regexp_matches(before, '[a-zA-Z0-9]')
      OR NOT regexp_matches(p, '[a-zA-Z0-9]') OR regexp_matches(plain, '^(?:{OPENINGS})')
      OR (regexp_matches(plain, '^{COPYRIGHT}') AND NOT regexp_matches(plain, '^{NO_COPYRIGHT}')) AS begins
  FROM beside),
numbered AS (SELECT *, sum(begins::INT) OVER (PARTITION BY r ORDER BY i) AS s FROM begun),
sentence AS (SELECT r, s, string_agg(p, ' ' ORDER BY i) AS whole, count(*) AS pieces FROM numbered GROUP BY r, s),
spoken AS (SELECT *, {_NORMAL.format(s="whole")} AS plain, regexp_matches(whole, '{TAG}') AS is_tag FROM sentence WHERE regexp_matches(whole, '(?i){KEYWORDS}')),
known AS (SELECT r, s, CASE WHEN pieces > 1 THEN {_IDENTIFIER.format(s="plain")} ELSE 'unknown' END AS known, is_tag FROM spoken),
each AS (
  SELECT n.r, n.s, i, {_IDENTIFIER.format(s="plain")} AS id
  FROM numbered n JOIN known k ON k.r = n.r AND k.s = n.s WHERE NOT is_tag AND regexp_matches(p, '(?i){KEYWORDS}')),
fitting AS (
  SELECT k.r, k.s, known NOT IN ('unknown', 'copyright') AND coalesce(bool_and(id IN ('unknown', 'copyright', known) OR id || '-later' = known), true) AS fits
  FROM known k LEFT JOIN each e ON e.r = k.r AND e.s = k.s WHERE NOT is_tag GROUP BY k.r, k.s, known),
tag AS (
  SELECT r, s, unnest(names) AS name, generate_subscripts(names, 1) AS i FROM (
    SELECT r, s, list_filter(regexp_split_to_array(regexp_replace(regexp_extract(whole, '{EXPRESSION}', 1), '{EXCEPTION}', '', 'g'), '{JOINT}'), lambda x: x <> '') AS names
    FROM spoken WHERE is_tag)),
named AS (
  SELECT k.r, k.s, 0 AS i, known AS id FROM known k JOIN fitting f ON f.r = k.r AND f.s = k.s WHERE fits
  UNION ALL SELECT e.r, e.s, i, id FROM each e JOIN fitting f ON f.r = e.r AND f.s = e.s WHERE NOT fits
  UNION ALL SELECT r, s, i, CASE WHEN lower(name) IN ({_TAGS}) THEN 'spdx-' || lower(name) ELSE 'unknown' END FROM tag),
sequence AS (
  SELECT r, string_agg(id, ',' ORDER BY s, i) AS ids, string_agg('<' || id || '>', '' ORDER BY s, i) AS tags, count(*) FILTER (id = 'unknown') AS n_unknown
  FROM named GROUP BY r),
rule(k, license, pattern) AS (VALUES {_RULE_ROWS}),
tried(r, k, tags, found) AS (
  SELECT r, 0, tags, []::VARCHAR[] FROM sequence
  UNION ALL
  SELECT t.r, rule.k, replace(t.tags, pattern, '|'),
    CASE WHEN contains(t.tags, pattern) AND NOT list_contains(found, license) THEN list_append(found, license) ELSE found END
  FROM tried t JOIN rule ON rule.k = t.k + 1)
SELECT doc_id, coalesce(ids, '') AS sentence_ids, coalesce(array_to_string(found, ','), '') AS licenses, coalesce(n_unknown, 0)::BIGINT AS n_unknown
FROM cut LEFT JOIN sequence USING (r) LEFT JOIN (SELECT * FROM tried WHERE k = {len(ALL_RULES)}) USING (r)
"""

OP8 = r"""
WITH RECURSIVE sized AS (
  SELECT row_number() OVER () AS r, doc_id, source,
    len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> ''))::BIGINT AS n_tokens,
    md5('0:' || coalesce(doc_id::VARCHAR, 'null')) AS draw
  FROM documents),
per_source AS (SELECT source, sum(n_tokens)::BIGINT AS total FROM sized GROUP BY source),
ends AS (SELECT min(total)::DOUBLE AS least, max(total)::DOUBLE AS most FROM per_source WHERE total > 0),
halving(k, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT k + 1,
    CASE WHEN pow(least, (lo + hi) / 2 - 1) / pow(most, (lo + hi) / 2 - 1) <= 2 THEN lo ELSE (lo + hi) / 2 END,
    CASE WHEN pow(least, (lo + hi) / 2 - 1) / pow(most, (lo + hi) / 2 - 1) <= 2 THEN (lo + hi) / 2 ELSE hi END
  FROM halving, ends WHERE k < 50),
chosen AS (SELECT round(CASE WHEN most / least <= 2 THEN 0 ELSE hi END, 9) AS alpha FROM halving, ends WHERE k = 50),
scaled AS (
  SELECT alpha, sum(pow(total, alpha)) AS scale, min(pow(total, alpha - 1)) AS lowest FROM per_source, chosen WHERE total > 0 GROUP BY alpha),
target AS (
  SELECT source, total, CASE WHEN total > 0 THEN alpha END AS alpha, CASE WHEN total > 0 THEN pow(total, alpha) / scale ELSE 0 END AS weight,
    CASE WHEN total > 0 THEN round(pow(total, alpha) / lowest)::BIGINT ELSE 0 END AS wanted
  FROM per_source, scaled),
dealt AS (
  SELECT r, doc_id, sized.source, n_tokens, alpha, weight, substr(draw, 9, 8) AS place,
    CASE WHEN total > 0 THEN wanted // total ELSE 1 END AS passes, CASE WHEN total > 0 THEN wanted % total ELSE 0 END AS rest,
    ('0x' || substr(draw, 1, 8))::BIGINT % greatest(ceil(total / 1000000.0)::BIGINT, 1) AS block
  FROM sized JOIN target ON sized.source IS NOT DISTINCT FROM target.source),
summed AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY source ORDER BY block, place, doc_id, n_tokens ROWS UNBOUNDED PRECEDING) AS upto FROM dealt)
SELECT doc_id, source, n_tokens, round(alpha, 6) AS alpha, round(weight, 6) AS weight,
  passes + CASE WHEN n_tokens > 0 AND upto <= rest THEN 1 ELSE 0 END AS copies
FROM summed
"""

OP10 = r"""
WITH body AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[ \t-\r]+', ' ', 'g') AS b FROM documents),
same AS (SELECT b, min(doc_id) AS keep_id, count(*) AS group_size FROM body GROUP BY b)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(b) AS text_sha256
FROM body JOIN same USING (b)
"""

_PLAIN_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

OP11 = rf"""
WITH {_CRC_TABLE},
doc AS (SELECT row_number() OVER () AS r, doc_id, {_PLAIN_WORDS} AS words FROM documents),
word AS (SELECT r, unnest(words) AS w FROM doc),
goal AS (SELECT unnest({_PLAIN_WORDS}) AS w FROM benchmark),
spelt AS (SELECT w, {_CRC} % 10000 AS b FROM (SELECT w FROM word UNION SELECT w FROM goal), crc_table),
s AS (SELECT b, count(*) AS s FROM word JOIN spelt USING (w) GROUP BY b),
t AS (SELECT b, count(*) AS t FROM goal JOIN spelt USING (w) GROUP BY b),
total AS (SELECT (SELECT count(*) FROM word)::DOUBLE AS s, (SELECT count(*) FROM goal)::DOUBLE AS t),
gain AS (
  SELECT b, floor(1000 * ln((coalesce(t.t, 0) + 1) * (total.s + 10000) / ((s.s + 1) * (total.t + 10000))))::BIGINT AS gain
  FROM s LEFT JOIN t USING (b), total),
weighed AS (SELECT r, sum(gain)::BIGINT AS weight FROM word JOIN spelt USING (w) JOIN gain USING (b) GROUP BY r),
scored AS (
  SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS score
  FROM doc LEFT JOIN weighed USING (r)),
placed AS (
  SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS place,
    10 * count(*) FILTER (n_features >= 20) OVER () // 100 AS drawn
  FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= drawn THEN place END AS rank FROM placed
"""

_FIELD = "coalesce(strlen({v}::VARCHAR) || ':' || {v}::VARCHAR, '-')"
_LEAF = " || ".join(_FIELD.format(v=v) for v in ("doc_id", "source", "lang", "n_chars"))
#: Levels of the trees that the SQL writes out: 8 ** 9 leaves.
_LEVELS = 9


def _tree(name: str, leaves: str) -> str:
    """CTEs <name>0.. of (tree, i, n, h, path): nodes of each level; of (tree, i, run): the hashes of each run."""
    out = [f"{name}0 AS ({leaves})"]
    for k in range(_LEVELS):
        out.append(
            f"{name}_run{k} AS (SELECT tree, i // 8 AS i, any_value(n) AS n, list(h ORDER BY i) AS run FROM {name}{k} WHERE n > 1 GROUP BY tree, i // 8)"
        )
        out.append(f"{name}{k + 1} AS (SELECT tree, i, (n + 7) // 8 AS n, sha256(array_to_string(run, '')) AS h FROM {name}_run{k})")
    tops = " UNION ALL ".join(f"SELECT tree, h FROM {name}{k} WHERE n = 1" for k in range(_LEVELS + 1))
    return ",\n".join([*out, f"{name}_top AS ({tops})"])


def _ascent(name: str, start: str, keep: str) -> str:
    """CTEs that carry each row of `start` (keep.., tree, i, folded, proof) up to its tree's top."""
    out, before = [], start
    for k in range(_LEVELS):
        left, right = "array_to_string(run[1:(c.i % 8)], '')", "array_to_string(run[(c.i % 8) + 2:], '')"
        out.append(
            f"{start}_{k} AS (SELECT {keep}, c.tree, c.i // 8 AS i, CASE WHEN run IS NULL THEN folded ELSE sha256({left} || folded || {right}) END AS folded, "
            f"CASE WHEN run IS NULL THEN proof ELSE proof || {left} || {right} END AS proof "
            f"FROM {before} c LEFT JOIN {name}_run{k} r ON r.tree = c.tree AND r.i = c.i // 8)"
        )
        before = f"{start}_{k}"
    return ",\n".join(out)


_KEEP = "c.doc_id, c.leaf"
OP12 = rf"""
WITH {_CRC_TABLE},
hashed AS (
  SELECT doc_id, lang, sha256({_LEAF} || {_FIELD.format(v="text")}) AS leaf,
    sha256({_LEAF} || {_FIELD.format(v="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) AS other,
    doc_id::VARCHAR AS w
  FROM documents),
langs AS (SELECT lang, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT lang FROM hashed)),
leaves AS (
  SELECT doc_id, leaf, CASE WHEN {_CRC} % 3 = 0 THEN other ELSE leaf END AS folded, '' AS proof, tree,
    row_number() OVER (PARTITION BY tree ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n
  FROM hashed JOIN langs ON hashed.lang IS NOT DISTINCT FROM langs.lang, crc_table),
{_tree("node", "SELECT tree, i, n, leaf AS h FROM leaves")},
{_tree("over", "SELECT 0 AS tree, tree AS i, count(*) OVER () AS n, h FROM node_top")},
{_ascent("node", "leaves", _KEEP)},
roots AS (SELECT {_KEEP}, c.tree AS own, 0 AS tree, c.tree AS i, folded, proof FROM leaves_{_LEVELS - 1} c),
{_ascent("over", "roots", _KEEP + ", c.own")}
SELECT doc_id, leaf, node_top.h AS subroot, over_top.h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = over_top.h AS verified
FROM roots_{_LEVELS - 1} c JOIN node_top ON node_top.tree = c.own, over_top
"""

OP13 = rf"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, {_PLAIN_WORDS} AS words FROM documents),
item AS (SELECT item_id, {_PLAIN_WORDS} AS words FROM benchmark),
phrase AS (
  SELECT DISTINCT item_id, least(len(words), 10) AS n, array_to_string(words[pos:pos + least(len(words), 10) - 1], ' ') AS p
  FROM (SELECT *, unnest(range(1, greatest(len(words) - 8, 2))) AS pos FROM item WHERE len(words) > 0)),
size AS (SELECT DISTINCT n FROM phrase),
place AS (SELECT r, words, n, unnest(range(1, len(words) - n + 2)) AS pos FROM doc, size WHERE len(words) >= n),
hit AS (SELECT r, pos, place.n, item_id FROM place JOIN phrase ON phrase.n = place.n AND p = array_to_string(words[pos:pos + place.n - 1], ' ')),
covered AS (SELECT r, count(DISTINCT pos + k) AS n_hit FROM hit, range(10) AS step(k) WHERE k < n GROUP BY r),
owned AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM hit) GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN covered USING (r) LEFT JOIN owned USING (r)
"""

ORACLES = {
    "op2_quality_rules": OP2,
    "op3_warc": OP3,
    "op4_jaccard_join": OP4,
    "op6_license_scan": OP6,
    "op8_mixing": OP8,
    "op10_exact_dedup": OP10,
    "op11_importance_resampling": OP11,
    "op12_merkle_manifest": OP12,
    "op13_decontamination": OP13,
}
