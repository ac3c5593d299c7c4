"""SQL for DuckDB that gives the rows of those queries which SQL can express: op2, op3, op4, op5, op8, op11 and op12.

Each text follows the definition of its operator (in its module) on plain rows, without its distribution.
"""

from __future__ import annotations

from . import chat_format, fingerprints, licenses, quality_rules, sharding

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ALL = (1 << 64) - 1


def _times(x: str, factor: int) -> str:
    """x * factor modulo 2 ** 64."""
    return f"((({x})::UHUGEINT * {factor}::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT"


def _plus(x: str, term: int) -> str:
    return f"((({x})::UHUGEINT + {term}::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT"


def _steps(relation: str, column: str, *steps: str) -> str:
    """relation with column replaced by each of the steps in turn; a step names the column before it as x."""
    for s in steps:
        relation = f"(SELECT * EXCLUDE (x), {s} AS x FROM {relation})"
    return f"(SELECT * EXCLUDE (x), x AS {column} FROM {relation})"


_FINALISER = ("xor(x, x >> 30)", _times("x", 0xBF58476D1CE4E5B9), "xor(x, x >> 27)", _times("x", 0x94D049BB133111EB), "xor(x, x >> 31)")

# -- op2 ------------------------------------------------------------------------------------------------------------------------


def op2() -> str:
    w, k = fingerprints.WINDOW, fingerprints.SKETCH
    hashes = [" + ".join(f"lead(c, {i}, 0) OVER ahead * {pow(b, i, p)} % {p}" for i in range(w)) for p, b in zip(fingerprints.PRIMES, fingerprints.BASES, strict=True)]
    packed = " | ".join((f"((({hashes[0]}) % {fingerprints.PRIMES[0]})::UBIGINT << 31)", f"(({hashes[1]}) % {fingerprints.PRIMES[1]})::UBIGINT"))
    windows = f"(SELECT r, kind, i, n, {packed} AS x FROM chars WINDOW ahead AS (PARTITION BY r, kind ORDER BY i))"
    windows = f"(SELECT * FROM {windows} WHERE i + {w} <= n OR (i = 0 AND n < {w}))"
    powers = ", ".join(
        f"pw{j} AS (SELECT 1 AS size, [1::BIGINT] AS l UNION ALL SELECT size * 2, list_concat(l, list_transform(l, lambda v: v * (l[size] * {b} % {p}) % {p})) FROM pw{j} WHERE size <= (SELECT max(n) FROM texts))"
        for j, (p, b) in enumerate(zip(fingerprints.PRIMES, fingerprints.BASES, strict=True))
    )
    flat = ", ".join(f"up{j} AS MATERIALIZED (SELECT unnest(l) AS u, unnest(range(size)) AS i FROM (SELECT * FROM pw{j} ORDER BY size DESC LIMIT 1))" for j in range(2))
    whole = ", ".join(f"(sum(c * up{j}.u % {p}) % {p})::BIGINT AS w{j}" for j, p in enumerate(fingerprints.PRIMES))
    like = f"CASE WHEN len({{a}}) + len({{b}}) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(list_intersect(list_sort(list_distinct(list_concat({{a}}, {{b}})))[1:{k}], {{a}}), {{b}})) / len(list_sort(list_distinct(list_concat({{a}}, {{b}})))[1:{k}])::DOUBLE END"
    return f"""WITH RECURSIVE rows_ AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
numbered AS (SELECT *, row_number() OVER (ORDER BY doc_id, t) AS r, count(*) OVER () AS rows FROM rows_ WHERE doc_id IS NOT NULL
  UNION ALL SELECT *, -row_number() OVER (ORDER BY t), 0 FROM rows_ WHERE doc_id IS NULL),
paired AS (SELECT a.*, CASE WHEN a.r < 0 THEN a.r ELSE a.r % a.rows + 1 END AS after FROM numbered a),
edited AS MATERIALIZED (SELECT a.*, left(a.t, length(a.t) - length(a.t) // 4) || left(b.t, length(a.t) // 4) AS e FROM paired a JOIN numbered b ON b.r = a.after),
texts AS MATERIALIZED (SELECT r, 'a' AS kind, t, length(t) AS n FROM edited UNION ALL SELECT r, 'e', e, length(e) FROM edited),
chars AS MATERIALIZED (SELECT r, kind, n, unnest(range(n)) AS i, (unicode(unnest(regexp_extract_all(t, '(?s).'))) + 1)::BIGINT AS c FROM texts WHERE n > 0),
{powers}, {flat},
least_ AS (SELECT r, kind, min(h, {k}) AS l FROM (SELECT DISTINCT r, kind, (h >> 16)::BIGINT AS h FROM {_steps(windows, "h", *_FINALISER)}) GROUP BY r, kind),
wholes AS (SELECT r, kind, {whole} FROM chars JOIN up0 USING (i) JOIN up1 USING (i) GROUP BY r, kind),
prints AS MATERIALIZED (SELECT t.r, t.kind, n, coalesce(l, []::BIGINT[]) AS l, format('{{:x}}', n) || '-' || format('{{:08x}}', coalesce(w0, 0)) || format('{{:08x}}', coalesce(w1, 0)) || '-' || array_to_string(list_transform(coalesce(l, []::BIGINT[]), lambda v: format('{{:012x}}', v)), '') AS f
  FROM texts t LEFT JOIN least_ s ON s.r = t.r AND s.kind = t.kind LEFT JOIN wholes w ON w.r = t.r AND w.kind = t.kind),
own AS MATERIALIZED (SELECT r, i, c, r * 4294967296 + i AS place FROM chars WHERE kind = 'a'),
theirs AS MATERIALIZED (SELECT 'e' AS kind, c, r * 4294967296 + i AS place FROM chars WHERE kind = 'e' UNION ALL SELECT 'n', c, p.r * 4294967296 + i FROM chars o JOIN paired p ON p.after = o.r WHERE o.kind = 'a'),
differ AS (SELECT r, kind, min(i) AS i FROM own JOIN theirs USING (place) WHERE own.c <> theirs.c GROUP BY r, kind)
SELECT d.doc_id, a.n AS n_chars, sha256(d.e) AS edited_sha256, a.f AS fingerprint, e.f AS edited_fingerprint, {like.format(a="a.l", b="e.l")} AS near_edited, {like.format(a="a.l", b="b.l")} AS near_next,
  coalesce(de.i, least(a.n, e.n))::BIGINT AS prefix_edited, coalesce(dn.i, least(a.n, b.n))::BIGINT AS prefix_next
FROM edited d JOIN prints a ON a.r = d.r AND a.kind = 'a' JOIN prints e ON e.r = d.r AND e.kind = 'e' JOIN prints b ON b.r = d.after AND b.kind = 'a'
LEFT JOIN differ de ON de.r = d.r AND de.kind = 'e' LEFT JOIN differ dn ON dn.r = d.r AND dn.kind = 'n'"""


# -- op3 ------------------------------------------------------------------------------------------------------------------------


def op3() -> str:
    phrases = [*licenses.BASE_PHRASES.items(), *licenses.NOTICES.items()]
    templates = ", ".join(f"({i}, '{phrase}', '{label}', {i < len(licenses.BASE_PHRASES)})" for i, (phrase, label) in enumerate(phrases))
    return rf"""WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
template AS (SELECT template, label, base, string_split(phrase, ' ') AS ws, len(string_split(phrase, ' ')) AS size FROM (VALUES {templates}) v(template, phrase, label, base)),
pairs AS (SELECT *, lead(w) OVER (PARTITION BY r ORDER BY pos) AS w2 FROM (SELECT r, unnest(ws) AS w, unnest(range(len(ws))) AS pos FROM docs)),
places AS (SELECT *, lead(w) OVER (PARTITION BY template ORDER BY place) AS w2 FROM (SELECT template, label, base, size, unnest(ws) AS w, unnest(range(size)) AS place FROM template)),
votes AS (SELECT p.r, q.template, q.label, q.base, q.size, q.place, p.pos - q.place AS diagonal FROM pairs p JOIN places q ON p.w = q.w AND p.w2 = q.w2),
lines AS (SELECT DISTINCT r, template, label, base, size, diagonal FROM votes),
matched AS (SELECT DISTINCT l.r, l.template, l.label, l.base, l.size, l.diagonal, v.place + unnest([0, 1]) AS word, v.diagonal AS own FROM lines l JOIN votes v ON v.r = l.r AND v.template = l.template AND v.diagonal BETWEEN l.diagonal AND l.diagonal + CASE WHEN l.size < {licenses.LONG} THEN 0 ELSE {licenses.DRIFT} END),
chains AS (SELECT r, template, label, base, any_value(size) AS size, diagonal, count(DISTINCT word) AS covered, list([own + word] ORDER BY word, own DESC) AS ats FROM (SELECT DISTINCT * FROM matched) m GROUP BY r, template, label, base, diagonal),
spans AS (SELECT r, template, label, base, diagonal, CASE WHEN covered >= size * {licenses.LEAST_SHARE} THEN
  len(list_reduce(ats, lambda ends, e: list_concat(list_filter(ends, lambda x: x < e[1]), e, ends[len(list_filter(ends, lambda x: x < e[1])) + 2:]), []::BIGINT[])) ELSE 0 END / size::DOUBLE AS share FROM chains)
SELECT doc_id, len(any_value(ws))::BIGINT AS n_words, count(*) FILTER (WHERE base AND share = 1) AS n_base, (min(diagonal) FILTER (WHERE base AND share = 1))::BIGINT AS first_word, (max(diagonal) FILTER (WHERE base AND share = 1))::BIGINT AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base AND share = 1), '') AS base_labels,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE share >= {licenses.LEAST_SHARE} AND (NOT base OR share = 1)), '') AS labels,
  coalesce(max(share) FILTER (WHERE share >= {licenses.LEAST_SHARE} AND (NOT base OR share = 1)), 0.0)::DOUBLE AS score
FROM docs d LEFT JOIN spans USING (r) GROUP BY d.r, doc_id"""


# -- op4 ------------------------------------------------------------------------------------------------------------------------

#: The multipliers of the public 64-bit xx hash, and the seed that Spark gives it.
_XX1, _XX2, _XX3, _XX4, _XX5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
_XX_SEED = 42


def _turned(x: str, by: int) -> str:
    """x rotated left, without the bits that leave 64."""
    return f"((({x}) & {_ALL >> by}::UBIGINT) << {by}) | (({x}) >> {64 - by})"


def _xx_int(value: int, seed: int) -> int:
    """The hash of a four-byte number, for constants."""
    h = (seed + _XX5 + 4) & _ALL
    h ^= value * _XX1 & _ALL
    h = ((h << 23 | h >> 41) * _XX2 + _XX3) & _ALL
    h = (h ^ h >> 33) * _XX2 & _ALL
    h = (h ^ h >> 29) * _XX3 & _ALL
    return h ^ h >> 32


def _xx_long(relation: str, source: str, column: str, seed: int) -> str:
    """relation with column: the signed hash of its eight-byte column source, as HUGEINT; null hashes to the seed."""
    steps = (
        _times("x", _XX2), _times(_turned("x", 31), _XX1), f"xor(x, {(seed + _XX5 + 8) & _ALL}::UBIGINT)", _times(_turned("x", 27), _XX1), _plus("x", _XX4),
        "xor(x, x >> 33)", _times("x", _XX2), "xor(x, x >> 29)", _times("x", _XX3), "xor(x, x >> 32)", f"coalesce(x, {seed}::UBIGINT)",
        "CASE WHEN x >= 9223372036854775808::UBIGINT THEN x::HUGEINT - 18446744073709551616::HUGEINT ELSE x::HUGEINT END",
    )
    return _steps(f"(SELECT *, (CASE WHEN {source} < 0 THEN {source}::HUGEINT + 18446744073709551616::HUGEINT ELSE {source}::HUGEINT END)::UBIGINT AS x FROM {relation})", column, *steps)


def _crc32(text: str) -> str:
    """The unsigned CRC-32 of a text's UTF-8 bytes."""
    table = []
    for i in range(8):
        c = 1 << i
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        table.append(c)
    step = "acc >> 8"
    for i, c in enumerate(table):
        step = f"xor({step}, ((xor(acc, v) >> {i}) & 1) * {c}::BIGINT)"
    return f"xor(list_reduce(list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda v: ('0x' || v)::BIGINT), lambda acc, v: {step}, 4294967295::BIGINT), 4294967295::BIGINT)"


def op4(shards: int = 24, seed: int = 29) -> str:
    rounds = "(SELECT *, y // b AS lo, y % b AS hi FROM walk WHERE step = 0 OR y >= rows)"
    for i in range(sharding.ROUNDS):
        moved, fixed, size = ("hi", "lo", "b") if i % 2 else ("lo", "hi", "a")
        hashed = _xx_long(rounds, fixed, "h", _xx_int(i, _xx_int(seed, _XX_SEED)))
        rounds = f"(SELECT * EXCLUDE (h, {moved}), (({moved} + (h % {size} + {size}) % {size}) % {size})::BIGINT AS {moved} FROM {hashed})"
    bucket = _xx_long("sized", "doc_id", "h", _XX_SEED)
    return f"""WITH RECURSIVE raw AS (SELECT doc_id::BIGINT AS doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + 8 AS size, coalesce(text, '') AS t FROM documents),
sized AS (SELECT doc_id, size, {_crc32("t")} AS text_crc32 FROM raw),
hashed AS (SELECT * FROM {bucket}),
numbered AS (SELECT *, row_number() OVER (ORDER BY (h % {sharding.BUCKETS} + {sharding.BUCKETS}) % {sharding.BUCKETS}, doc_id NULLS FIRST, text_crc32, size) - 1 AS row_number, count(*) OVER () AS rows FROM hashed),
digits AS (SELECT *, greatest(ceil(sqrt(rows)), 1)::BIGINT AS a FROM numbered),
walk AS (SELECT row_number, rows, a, ceil(rows / a)::BIGINT AS b, row_number AS y, 0 AS step FROM digits
  UNION ALL SELECT row_number, rows, a, b, lo * b + hi, step + 1 FROM {rounds})
SELECT doc_id, size, text_crc32, 'rows' AS law, (y % {shards})::INT AS shard, (y // {shards})::BIGINT AS slot, NULL::INT AS grown_shard, row_number, y AS position
FROM numbered JOIN (SELECT row_number, y, rows AS n FROM walk WHERE step > 0 AND y < rows) USING (row_number)"""


# -- op5 ------------------------------------------------------------------------------------------------------------------------


def op5() -> str:
    q = quality_rules
    n, mean = "greatest(n_words, 1)", "(word_chars / greatest(n_words, 1)::DOUBLE)"
    rules = (
        ("n_words < 10", "n_words >= 30"),
        (f"n_repeat_words * 8 > {n}", f"n_repeat_words * 25 <= {n}"),
        (f"n_symbols * 20 > {n}", f"n_symbols * 100 <= {n}"),
        (f"n_odd * 5 > {n}", f"n_odd * 10 <= {n}"),
        (f"n_shouted * 10 > {n}", f"n_shouted * 30 <= {n}"),
        (f"n_exclaimed * 20 > {n}", f"n_exclaimed * 100 <= {n}"),
        (f"n_distinct * 4 < {n} AND {n} < 2000", f"n_distinct * 2 >= {n}"),
        (f"n_dup_lines * 40 > {n}", "n_dup_lines = 0"),
        (f"n_stops * 40 < {n}", f"n_stops * 20 >= {n}"),
        (f"{mean} < 3 OR {mean} > 9", f"{mean} >= 4 AND {mean} <= 7"),
    )
    cast = ", ".join(f"CASE WHEN {bad} THEN {q.BAD} WHEN {good} THEN {q.GOOD} ELSE {q.ABSTAIN} END" for bad, good in rules)
    rate = "({mean} * {weight} * total + fsum(CASE WHEN v = {bad} THEN c * ({side}) ELSE 0 END)) / ({weight} * total + fsum(CASE WHEN v <> {abstain} THEN c * ({side}) ELSE 0 END))"
    on_bad, on_good = (rate.format(mean=m, weight=w, bad=q.BAD, abstain=q.ABSTAIN, side=side) for (m, w), side in ((q.PRIOR_BAD, "1 - good"), (q.PRIOR_GOOD, "good")))
    return rf"""WITH RECURSIVE docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
words AS (SELECT r, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM docs),
windows AS (SELECT r, i, [w, {", ".join(f"lead(w, {i}) OVER ahead" for i in range(1, q.WINDOW))}] AS g, lead(w, {q.WINDOW - 1}) OVER ahead IS NOT NULL AS full_ FROM words WINDOW ahead AS (PARTITION BY r ORDER BY i)),
twice AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS times FROM windows WHERE full_),
repeats AS (SELECT r, count(DISTINCT pos) AS n FROM (SELECT r, i + unnest(range({q.WINDOW})) AS pos FROM twice WHERE times > 1) GROUP BY r),
features AS (SELECT d.r, doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  (len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
  coalesce(n, 0)::BIGINT AS n_repeat_words, len(regexp_extract_all(t, '\p{{Lu}}{{2,}}')) AS n_shouted, len(regexp_extract_all(t, '[!?]{{2,}}')) AS n_exclaimed, len(list_distinct(ws)) AS n_distinct,
  len(regexp_extract_all(t, '[^\p{{L}}\p{{M}}\x20\x09-\x0D.,;:!?''\x{{2019}}()"-]+')) AS n_odd, len(regexp_extract_all(t, '[.!?](?:[\x20\x09-\x0D]|$)')) AS n_stops FROM docs d LEFT JOIN repeats USING (r)),
voted AS (SELECT *, [{cast}] AS votes FROM features),
patterns AS (SELECT votes, count(*) AS c, (SELECT count(*) FROM voted) AS total FROM voted GROUP BY votes),
em AS (SELECT 0 AS step, votes, c, total, CASE WHEN list_contains(votes, {q.BAD}) THEN 0.1::DOUBLE ELSE 0.95::DOUBLE END AS good, 1.0::DOUBLE AS change FROM patterns
  UNION ALL SELECT step + 1, votes, c, total, new, max(abs(new - good)) OVER () FROM (
    SELECT e.step, e.votes, e.c, e.total, e.good, 1 / (1 + exp(-(any_value(ln(share / (1 - share))) + fsum(CASE e.v WHEN {q.BAD} THEN ln(on_good / on_bad) WHEN {q.GOOD} THEN ln((1 - on_good) / (1 - on_bad)) ELSE 0 END)))) AS new
    FROM (SELECT *, unnest(votes) AS v, unnest(range({len(rules)})) AS j FROM em) e
    JOIN (SELECT j, {on_bad} AS on_bad, {on_good} AS on_good FROM (SELECT *, unnest(votes) AS v, unnest(range({len(rules)})) AS j FROM em) GROUP BY j, total) rates ON rates.j = e.j
    CROSS JOIN (SELECT (1 + fsum(c * good)) / (2 + any_value(total)) AS share FROM em) s
    WHERE e.change >= {q.TOLERANCE}::DOUBLE AND e.step < {q.ITERATIONS} GROUP BY e.step, e.votes, e.c, e.total, e.good)),
final AS (SELECT votes, good FROM em WHERE step = (SELECT max(step) FROM em))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 10 OR n_repeat_words * 100 > n_words * 20) AS base_failed,
  (NOT (n_words < 10 OR n_repeat_words * 100 > n_words * 20) AND good >= 0.5) AS kept, round(good, 6) AS p_good, array_to_string(votes, '') AS votes
FROM voted JOIN final USING (votes)"""


# -- op8 ------------------------------------------------------------------------------------------------------------------------


def op8() -> str:
    said = "<|im_end|><|im_start|>assistant ok"
    fixed = len(chat_format.START) + len(chat_format.END) + 1
    escaped = lambda x: rf"length(regexp_replace({x}, '<(\\*)\|', '<\\\1|', 'g'))"
    order = "ORDER BY turn NULLS FIRST, role, t"
    return rf"""WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations UNION ALL VALUES (-1, 0, 'user', '{said}'), (-1, 1, '{chat_format.LEARNED}', '{said}'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' {order})) AS turns_sha256, coalesce(sum(length(t)) FILTER (WHERE role = '{chat_format.LEARNED}'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(t, '' {order}) FILTER (WHERE role = '{chat_format.LEARNED}'), '')) AS loss_sha256,
  sum({fixed} + {escaped(r"replace(replace(role, '\', '\\'), chr(10), '\n')")} + {escaped("t")})::BIGINT AS formatted_chars FROM turns GROUP BY conv_id"""


# -- op11 -----------------------------------------------------------------------------------------------------------------------


def op11(buckets: int = 10_000, least_words: int = 20, percent: int = 10, seed: int = 2024) -> str:
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    counts = "SELECT bucket, count(*)::BIGINT AS n, sum(count(*)) OVER ()::BIGINT AS total FROM {} JOIN hashed USING (w) GROUP BY bucket"
    return f"""WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {words} AS ws FROM documents),
words AS MATERIALIZED (SELECT r, unnest(ws) AS w FROM docs),
aims AS MATERIALIZED (SELECT unnest({words}) AS w FROM benchmark),
hashed AS MATERIALIZED (SELECT w, {_crc32("w")} % {buckets} AS bucket FROM (SELECT w FROM words UNION SELECT w FROM aims)),
source AS ({counts.format("words")}), target AS ({counts.format("aims")}),
gains AS (SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (coalesce((SELECT max(total) FROM source), 0) + {buckets})::DOUBLE / ((coalesce(s.n, 0) + 1)::DOUBLE * (coalesce((SELECT max(total) FROM target), 0) + {buckets})::DOUBLE)))::BIGINT AS gain
  FROM source s FULL JOIN target t USING (bucket)),
weights AS (SELECT r, sum(gain)::BIGINT AS weight FROM words JOIN hashed USING (w) JOIN gains USING (bucket) GROUP BY r),
scored AS (SELECT r, doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('{seed}:' || coalesce(doc_id::VARCHAR, '')), 8))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM docs LEFT JOIN weights USING (r)),
ranked AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS place, {percent} * count(*) OVER () // 100 AS drawn FROM scored WHERE n_features >= {least_words})
SELECT doc_id, n_features, weight, score, CASE WHEN place <= drawn THEN place END AS rank FROM scored LEFT JOIN ranked USING (r)"""


# -- op12 -----------------------------------------------------------------------------------------------------------------------


def op12(least: int = 24, times: int = 3) -> str:
    """Places whose next words equal those q further on come from a join on grams as long as the shortest run needs."""
    gram = 8
    ahead = ", ".join(f"lead(w, {i}) OVER ahead" for i in range(1, gram))
    return rf"""WITH raw AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, {_crc32("doc_id::VARCHAR")} AS h FROM documents),
tails AS (SELECT *, len(ws) AS n, (h // 10) % nullif(len(ws), 0) AS a, h // 10 AS g FROM raw),
docs AS MATERIALIZED (SELECT r, doc_id, n, CASE WHEN coalesce(h % 10 = 0, false) AND n > 0 THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN ws[i + 1] ELSE ws[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] END) ELSE ws END AS ws FROM tails),
words AS (SELECT r, n, unnest(ws) AS w, unnest(range(n)) AS i FROM docs WHERE n > 0),
grams AS MATERIALIZED (SELECT r, n, i, hash(w, {ahead}) AS h, [w, {ahead}] AS g, lead(i, {gram - 1}) OVER ahead IS NOT NULL AS whole FROM words WINDOW ahead AS (PARTITION BY r ORDER BY i)),
equal_ AS (SELECT a.r, a.i, b.i - a.i AS q FROM grams a JOIN grams b ON a.r = b.r AND a.h = b.h AND a.g = b.g AND b.i > a.i AND (b.i - a.i) * {times} <= a.n WHERE a.whole AND b.whole),
islands AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM equal_),
stretches AS (SELECT r, min(i) AS start, count(*) + {gram - 1} + q AS length, q FROM islands GROUP BY r, q, island HAVING count(*) + {gram - 1} + q >= greatest({least}, {times} * q)),
runs AS (SELECT r, start, length, min(q) AS period FROM stretches GROUP BY r, start, length),
listed AS (SELECT r, count(*) AS n_runs, list({{'start': start, 'length': length, 'period': period}} ORDER BY length / period::DOUBLE DESC, start, period) AS best,
  string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best[1].start::BIGINT AS start, best[1].length::BIGINT AS length, best[1].period::BIGINT AS period, (1000 * best[1].length // best[1].period)::BIGINT AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256,
  sha256(array_to_string(list_transform(list_filter(range(n), lambda i: len(list_filter(coalesce(best, []), lambda x: i >= x.start + x.period AND i < x.start + x.length)) = 0), lambda i: ws[i + 1]), ' ')) AS collapsed_sha256
FROM docs LEFT JOIN listed USING (r)"""


def texts() -> dict[str, str]:
    return {"op2_prefix_fingerprints": op2(), "op3_license_diagonals": op3(), "op4_feistel_shards": op4(), "op5_weak_supervision": op5(), "op8_chat_bytes": op8(), "op11_importance_resample": op11(), "op12_periodic_runs": op12()}
