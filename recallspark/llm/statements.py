"""SQL of the ranked search, the spellings and the shards, for an independent engine."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The checksum's table by its rule, and the checksum of a text's bytes as a fold.
CRC_TABLE = """crc_steps(i, k, c) AS (
  SELECT i, 0, i FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM crc_steps WHERE k < 8
), crc_table AS (SELECT list(c ORDER BY i) AS crcs FROM crc_steps WHERE k = 8)"""


def crc32(hexadecimal: str) -> str:
    digits = f"list_transform(regexp_extract_all({hexadecimal}, '..'), lambda d: ('0x' || d)::BIGINT)"
    return (
        f"xor(list_reduce(list_prepend(4294967295, {digits}),"
        " lambda a, b: xor(a // 256, list_extract(crcs, xor(a % 256, b) + 1))), 4294967295)"
    )


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _terms(table: str, key: str) -> str:
    return f"SELECT {key}, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{_TERM}')) AS term FROM {table}"


RANKED = f"""
WITH words AS ({_terms("documents", "doc_id")}
), tfs AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL
), sizes AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tfs GROUP BY doc_id
), whole AS (SELECT count(*) AS total, sum(n)::BIGINT AS length FROM sizes
), weights AS (
  SELECT term, floor(1000 * ln((2 * total + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tfs, whole GROUP BY term, total
), asked AS (SELECT item_id, term, count(*) AS c FROM ({_terms("benchmark", "item_id")}) GROUP BY ALL
), scored AS (
  SELECT item_id, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * total) // length))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN tfs USING (term) JOIN sizes USING (doc_id), whole GROUP BY ALL
)
SELECT item_id, CAST(row_number() OVER w AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
WINDOW w AS (PARTITION BY item_id ORDER BY score DESC, doc_id)
QUALIFY row_number() OVER w <= 10"""

SPELLING = f"""
WITH RECURSIVE {CRC_TABLE}, runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[a-zÀ-ÿ]+')) AS run FROM documents
), counted AS (
  SELECT doc_id, run, count(*) AS k, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM runs WHERE length(run) >= 5 GROUP BY ALL
), hashed AS (SELECT run, k, {crc32("x")} AS h FROM counted, crc_table
), read AS (
  SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, k FROM hashed
), words AS (SELECT word, sum(k)::BIGINT AS n FROM read WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3
), cut AS (
  SELECT word, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(length(word)))::INT AS i FROM words)
), pairs AS (
  SELECT a.word, b.word AS other FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, w.word FROM cut c JOIN words w ON c.rest = w.word
  UNION SELECT w.word, c.word FROM cut c JOIN words w ON c.rest = w.word
), best AS (
  SELECT p.word, count(*) AS n_near, arg_min(w.word, (-w.n, w.word)) AS top, max(w.n) AS top_n
  FROM pairs p JOIN words w ON p.other = w.word GROUP BY p.word
), forms AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN top_n >= 2 * n THEN top END AS form, CASE WHEN top_n >= 2 * n THEN top_n END AS form_n
  FROM words LEFT JOIN best USING (word)
), chains(word, root, form) AS (
  SELECT word, word, form FROM forms
  UNION ALL SELECT c.word, f.word, f.form FROM chains c JOIN forms f ON c.form = f.word
)
SELECT word, n, n_near, form, form_n, root FROM forms JOIN (SELECT word, root FROM chains c WHERE c.form IS NULL) USING (word)"""


def _bucket(value: str) -> str:
    over = f"greatest(length(bin({value})) - 11, 0)"
    return f"({over} * 1024 + ({value} >> {over}::INT))::INT"


def _turned(source: str, bits: int, n: int) -> str:
    """Coordinates turned level by level, one nested step each."""
    names = [f"x{i}" for i in range(n)]
    for b in range(bits - 1, 0, -1):
        for i in range(n):
            low = f"{(1 << b) - 1}"
            swap = f"CASE WHEN x{i} & {1 << b} <> 0 THEN 0 ELSE xor(x0, x{i}) & {low} END"
            flip = f"CASE WHEN x{i} & {1 << b} <> 0 THEN {low} ELSE xor(x0, x{i}) & {low} END"
            new = [f"xor(x0, {flip}) AS x0" if k == 0 else f"xor(x{k}, {swap}) AS x{k}" if k == i else f"x{k}" for k in range(n)]
            source = f"(SELECT {', '.join(new)}, * EXCLUDE ({', '.join(names)}) FROM {source})"
    for i in range(1, n):
        source = f"(SELECT *, xor(g{i - 1}, x{i}) AS g{i} FROM {source if i > 1 else f'(SELECT *, x0 AS g0 FROM {source})'})"
    # xor of 2^b - 1 over set bits b: bit j of it is the parity of the set bits above j
    carry = " + ".join(
        f"((({' + '.join(f'((g{n - 1} >> {b}) & 1)' for b in range(j + 1, bits))}) % 2) << {j})" for j in range(bits - 1)
    )
    source = f"(SELECT *, {carry} AS carry FROM {source})"
    place = " + ".join(
        f"(((xor(g{i}, carry) >> {b}) & 1)::BIGINT << {b * n + (n - 1 - i)})" for b in range(bits) for i in range(n)
    )
    return f"(SELECT *, {place} AS curve FROM {source})"


def sharded(shards: int, bits: int) -> str:
    names = ["source", "lang"]
    buckets = [f"('0x' || substr(md5(coalesce({c}, '')), 1, 4))::INT AS v{i}" for i, c in enumerate(names)]
    for i, c in enumerate(["n_chars", "doc_id"], start=2):
        value = f"greatest(coalesce({c}, 0), 0) - greatest(coalesce((SELECT min({c}) FROM documents), 0), 0)"
        buckets.append(f"{_bucket(f'greatest({value}, 0)')} AS v{i}")
    levels = [
        f"l{i} AS (SELECT v{i}, ((coalesce(sum(count(*)) OVER (ORDER BY v{i} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * {1 << bits})"
        f" // sum(count(*)) OVER ())::INT AS x{i} FROM keys GROUP BY v{i})"
        for i in range(4)
    ]
    joined = "(SELECT * FROM keys " + " ".join(f"JOIN l{i} USING (v{i})" for i in range(4)) + ")"
    return f"""
WITH RECURSIVE {CRC_TABLE}, bytes AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, {', '.join(buckets)} FROM documents
), keys AS (
  SELECT doc_id, strlen(x) // 2 + 1 AS size, {crc32("x")} AS text_crc32, v0, v1, v2, v3 FROM bytes, crc_table
), {', '.join(levels)}, placed AS (
  SELECT doc_id, size, text_crc32, curve, row_number() OVER (ORDER BY curve, doc_id NULLS FIRST, text_crc32, size) - 1 AS place, count(*) OVER () AS total
  FROM {_turned(joined, bits, 4)}
), cut AS (SELECT *, place * {shards} // total AS shard FROM placed)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard::INT AS shard, place - (shard * total + {shards - 1}) // {shards} AS slot,
  NULL::INT AS grown_shard, curve
FROM cut"""
