"""SQL counterparts of the corpus queries that SQL can express."""

ORACLES: dict[str, str] = {}

# Shards: order by document id and checksum; the row's middle byte decides. The checksum is the usual
# reflected CRC-32, its byte table made by the polynomial.
ORACLES["op4_prefix_sum_shards"] = """
WITH bits AS (
  SELECT list_reduce([i::BIGINT] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
    lambda c, x: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) AS entry, i
  FROM range(256) t(i)),
codes AS (SELECT list(entry ORDER BY i) AS crc_table FROM bits),
sized AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 8 AS size,
    xor(list_reduce([4294967295::BIGINT] ||
      list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT),
      lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM documents, codes),
summed AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING) - size AS before,
    row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS place, sum(size) OVER () AS total
  FROM sized),
placed AS (SELECT *, least((2 * 24 * before + 24 * size) // (2 * total), 23)::INTEGER AS shard FROM summed)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
  place - min(place) OVER (PARTITION BY shard) AS slot, NULL::INTEGER AS grown_shard
FROM placed"""

ORACLES["op2_quality_ledger"] = r"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents),
counted AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    length(regexp_replace(t, '[^!]', '', 'g')) AS n_exclaim,
    length(regexp_replace(t, '\P{Lu}', '', 'g')) AS n_capitals,
    length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    row_number() OVER () AS id
  FROM base),
windows AS (
  SELECT id, i, list_slice(w, i, i + 4) AS g FROM (SELECT id, w, unnest(range(1, len(w) - 3)) AS i FROM counted)),
repeated AS (
  SELECT id, i FROM windows QUALIFY count(*) OVER (PARTITION BY id, g) > 1),
covered AS (
  SELECT id, count(DISTINCT i + d) AS n FROM repeated, range(5) r(d) GROUP BY id),
measured AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, word_chars, n_symbols, n_exclaim, n_capitals, len(l)::BIGINT AS n_lines,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM counted LEFT JOIN covered USING (id)),
judged AS (
  SELECT *, ((n_words < 10)::BIGINT + 2 * (100 * n_repeat_words > 20 * n_words)::BIGINT
    + 4 * (10 * n_symbols > n_words)::BIGINT + 8 * (100 * n_dup_lines > 50 * n_lines)::BIGINT
    + 16 * (word_chars > 15 * n_words)::BIGINT + 32 * (2 * n_capitals > word_chars)::BIGINT
    + 64 * (10 * n_exclaim > n_words)::BIGINT)::BIGINT AS failed
  FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed,
  failed = 0 AS kept, failed
FROM judged"""

ORACLES["op10_mix_sources"] = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS draw
  FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank, 3.0::DOUBLE * source_size AS cap,
    [5.0::DOUBLE, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM sources),
leveled AS (
  SELECT *, row_number() OVER w AS place,
    (sum(source_size) OVER () - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl
  FROM ranked WINDOW w AS (ORDER BY cap / weight, rank)),
common AS (SELECT arg_min(lvl, place) AS lvl FROM leveled WHERE cap > lvl * weight),
targets AS (
  SELECT l.source, source_size, rank, least(cap, coalesce(c.lvl * weight, cap)) AS target
  FROM leveled l CROSS JOIN common c),
seats AS (
  SELECT rank, target, s.k,
    row_number() OVER (ORDER BY target / (2 * s.k + 1) DESC, rank, s.k) AS place,
    floor((SELECT sum(target) FROM targets) / 64) AS house
  FROM targets, LATERAL (SELECT unnest(range(0, (target / 64)::BIGINT + 40)) AS k) s
  WHERE target > 0),
quotas AS (SELECT rank, count(*) FILTER (place <= house) AS blocks FROM seats GROUP BY rank),
plan AS (
  SELECT t.*, coalesce(blocks, 0)::BIGINT AS blocks, least(coalesce(blocks, 0) * 64, 3 * source_size) AS run
  FROM targets t LEFT JOIN quotas USING (rank)),
placed AS (
  SELECT s.*, p.source_size, p.target, p.blocks, p.run,
    sum(s.size) OVER (PARTITION BY s.source ORDER BY s.draw, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) - s.size AS ahead
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, source, blocks,
  (CASE WHEN source_size > 0 THEN run // source_size * size
     + greatest(0, least(run % source_size - ahead, size)) ELSE 0 END)::BIGINT AS taken
FROM placed"""


def _levels(name: str, leaves: str, depth: int) -> str:
    """Tables name0, name1, ... of ``g, i, h``: the nodes of each level; a lone node goes up unchanged."""
    found = [f"{name}0 AS (SELECT g, i, h, count(*) OVER (PARTITION BY g) AS n FROM {leaves})"]
    for k in range(depth):
        found.append(f"""{name}{k + 1} AS (
  SELECT *, count(*) OVER (PARTITION BY g) AS n FROM (
    SELECT g, CASE WHEN n > 1 THEN i // 8 ELSE 0 END AS i,
      CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE min(h) END AS h
    FROM (SELECT g, i AS i, h, n FROM {name}{k}) GROUP BY g, CASE WHEN n > 1 THEN i // 8 ELSE 0 END))""")
    return ",\n".join(found)


def _folds(name: str, start: str, depth: int) -> str:
    """Tables fold_name0, ...: each row's own node replaced by ``cur``, and the siblings passed so far."""
    found = [f"fold_{name}0 AS ({start})"]
    for k in range(depth):
        found.append(f"""fold_{name}{k + 1} AS (
  SELECT f.id, any_value(f.g) AS g, any_value(CASE WHEN m.n > 1 THEN f.i // 8 ELSE 0 END) AS i,
    CASE WHEN any_value(m.n) > 1 THEN sha256(string_agg(CASE WHEN m.i = f.i THEN f.cur ELSE m.h END, '' ORDER BY m.i))
      ELSE any_value(f.cur) END AS cur,
    any_value(f.proof) || coalesce(string_agg(m.h, '' ORDER BY m.i) FILTER (m.i <> f.i), '') AS proof
  FROM fold_{name}{k} f JOIN {name}{k} m ON m.g = f.g AND m.i // 8 = f.i // 8 GROUP BY f.id)""")
    return ",\n".join(found)


# Trees of up to 8**8 leaves in a language and 8**4 languages. The checksum is made as above.
ORACLES["op13_merkle_manifest"] = f"""
WITH bits AS (
  SELECT list_reduce([i::BIGINT] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
    lambda c, x: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) AS entry, i
  FROM range(256) t(i)),
codes AS (SELECT list(entry ORDER BY i) AS crc_table FROM bits),
changed AS (
  SELECT d.*, CASE WHEN doc_id IS NOT NULL AND xor(list_reduce([4294967295::BIGINT] ||
      list_transform(regexp_extract_all(hex(encode(doc_id::VARCHAR)), '..'), lambda h: ('0x' || h)::BIGINT),
      lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1])), 4294967295) % 3 = 0
    THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS other
  FROM documents d, codes),
parts AS (
  SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-')
      || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
      || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') AS head
  FROM changed),
hashed AS (
  SELECT doc_id, coalesce('=' || lang, '') AS g, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS h,
    sha256(head || coalesce(strlen(other) || ':' || other, '-')) AS cur
  FROM parts),
leaves AS (
  SELECT *, row_number() OVER () AS id,
    row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i FROM hashed),
{_levels("node", "leaves", 8)},
heads AS (SELECT '' AS g, row_number() OVER (ORDER BY encode(g)) - 1 AS i, h, g AS lang FROM node8),
{_levels("top", "heads", 4)},
{_folds("node", "SELECT id, g, i, cur, '' AS proof FROM leaves", 8)},
{_folds("top", "SELECT f.id, '' AS g, s.i, f.cur, f.proof FROM fold_node8 f JOIN heads s ON s.lang = f.g", 4)}
SELECT l.doc_id, l.h AS leaf, s.h AS subroot, t.h AS root, sha256(f.proof) AS proof_sha256, f.cur AS folded_root,
  f.cur = t.h AS verified
FROM leaves l JOIN heads s ON s.lang = l.g JOIN fold_top4 f USING (id) CROSS JOIN top4 t"""

ORACLES["op11_collocations"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM worded GROUP BY lang),
grams AS (
  SELECT lang, size, list_slice(w, i, i + size - 1) AS g
  FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM worded, range(1, 5) t(size))),
counted AS (SELECT lang, size, array_to_string(g, ' ') AS phrase, count(*) AS f FROM grams GROUP BY ALL),
frequent AS (SELECT *, string_split(phrase, ' ') AS w FROM counted WHERE f >= 30),
cuts AS (
  SELECT lang, size, phrase, f AS a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS rest
  FROM (SELECT *, unnest(range(1, size)) AS k FROM frequent WHERE size > 1)),
scored AS (
  SELECT c.*, x.f AS l, y.f AS r, ((2000000::HUGEINT * a) // (x.f + y.f))::BIGINT AS score
  FROM cuts c JOIN frequent x ON x.lang = c.lang AND x.phrase = head JOIN frequent y ON y.lang = c.lang AND y.phrase = rest),
best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (
  SELECT lang, array_to_string(w[i:i + len - 1], ' ') AS phrase, max(f) AS most
  FROM (SELECT lang, w, f, len, unnest(range(1, size - len + 2)) AS i
        FROM (SELECT *, unnest(range(2, size)) AS len FROM frequent WHERE size > 2))
  GROUP BY ALL),
kept AS (
  SELECT b.* FROM best b LEFT JOIN longer o USING (lang, phrase) WHERE most IS NULL OR 100 * most < 80 * a)
SELECT lang, row_number() OVER w AS rank, phrase, a, l, r, n, score
FROM kept JOIN totals USING (lang)
WINDOW w AS (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase))
QUALIFY rank <= 2000"""
