"""SQL for the registered queries that SQL can express on whole tables.

SimHash (a hash that SQL lacks), BPE and the classifier have none: they are tested against plain versions, an exact round trip and
held-out labels.
"""

from .license_texts import TEMPLATES
from .queries import SHARDS, TABLE_SIZE

_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_HASH = "('0x' || substr(md5({0}), 1, 15))::BIGINT"

#: One of some (cost, audit, text) by cost and audit; what a letter adds to one.
_BEST = "list_sort([{}])[1]"
_ADD = "{{'c': {0}.c + {1}, 'a': {0}.a || '{2}', 'r': {0}.r || {3}}}"


def _edits() -> str:
    """New (cost, audit, text) for the four states after a row, from those before it with its inserts (p0..p3)."""
    drop = lambda p: _ADD.format(p, 2, "D", "''")
    keep = lambda p, ok: _ADD.format(p, f"CASE WHEN {ok} AND NOT must THEN extra ELSE 1000000000000 END", "K", "chr(10) || role || ':' || text")
    turn = lambda p, to: _ADD.format(p, "CASE WHEN must THEN 1000000000000 ELSE 1 + extra END", "R", f"chr(10) || '{to}:' || text")
    to = lambda ps, role: [f(p) for p in ps for f in (lambda p: keep(p, f"i = '{role[0]}'"), lambda p: turn(p, role))]
    rows = [[drop("p0")], [drop("p1"), keep("p0", "i = 's'")], [drop("p2"), *to(("p0", "p1", "p3"), "user")], [drop("p3"), *to(("p2",), "assistant")]]
    return ", ".join(f"{_BEST.format(', '.join(r))} AS s{k}" for k, r in enumerate(rows))


_IN_USER, _IN_ASSISTANT = "chr(10) || 'user:'", "chr(10) || 'assistant:'"
_QUOTED = ", ".join("({}, '{}', '{}')".format(i, name, text.replace("'", "''")) for i, name, text in TEMPLATES)

ORACLES: dict[str, str] = {
    "op1_line_dedup": f"""
        WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        lines AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM split),
        keyed AS (SELECT *, {_LOWER.format(f"trim(line, {_BLANK})")} AS k FROM lines),
        common AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
        marked AS (SELECT doc_id, pos, line, c.k IS NOT NULL AND doc_id <> keeper AS gone FROM keyed LEFT JOIN common c USING (k))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id""",
    # Windows of twice a template's length, rounded up to a power of two, that overlap by half; five-word runs. All templates have five words or more.
    "op2_license_scan": f"""
        WITH t AS (SELECT id, license, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM (VALUES {_QUOTED}) v(id, license, text)),
        tr AS (SELECT DISTINCT id, license, half, array_to_string(w[p:p + 4], ' ') AS r FROM (SELECT *, greatest(8, pow(2, ceil(log2(len(w)))))::BIGINT AS half, unnest(range(1, len(w) - 3)) AS p FROM t)),
        n AS (SELECT id, count(*) AS n FROM tr GROUP BY 1),
        d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents),
        dr AS (SELECT row, doc_id, p - 1 AS i, array_to_string(w[p:p + 4], ' ') AS r FROM (SELECT *, unnest(range(1, greatest(len(w) - 3, 1))) AS p FROM d)),
        m AS (SELECT row, doc_id, id, license, half, r, i, unnest([i // half, i // half - 1]) AS k FROM dr JOIN tr USING (r)),
        f AS (SELECT row, doc_id, license, count(DISTINCT r) / any_value(n) AS share FROM m JOIN n USING (id) WHERE k >= 0 AND i - k * half <= 2 * half - 5 GROUP BY row, doc_id, id, license, k HAVING count(DISTINCT r) / any_value(n) >= 0.8)
        SELECT doc_id, count(*) AS n_matches, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses, round(max(share), 6) AS best_containment FROM f GROUP BY 1""",
    "op3_embedding_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
        n AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v),
        links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id
                  WHERE list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.93),
        reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
        SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, min(b) AS component_id, min(b) = vec_id AS kept
        FROM v JOIN reach ON reach.a = vec_id GROUP BY vec_id""",
    "op5_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        d AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha256(h) AS payload_digest FROM p),
        f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM d)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN first <> page_id THEN first END AS refers_to
        FROM f""",
    # Every claim is one step: the shard whose turn it is takes the first free slot of its order.
    "op6_sharding": f"""
        WITH RECURSIVE shards AS (SELECT i AS s, name, {_HASH.format("'offset:' || name")} % {TABLE_SIZE} AS start, {_HASH.format("'skip:' || name")} % {TABLE_SIZE - 1} + 1 AS skip
                                  FROM (SELECT unnest({SHARDS!r}) AS name, unnest(range({len(SHARDS)})) AS i)),
        starts AS (SELECT list(start ORDER BY s) AS start, list(skip ORDER BY s) AS skip FROM shards),
        inverses AS (SELECT list(i ORDER BY s) AS inverse FROM (SELECT s, x AS i FROM shards, range(1, {TABLE_SIZE}) t(x) WHERE (skip * x) % {TABLE_SIZE} = 1)),
        fill(turn, free, slot) AS (
          SELECT 0, range({TABLE_SIZE}), NULL::BIGINT
          UNION ALL
          SELECT turn + 1, list_filter(free, lambda x: x <> pick), pick FROM (
            SELECT turn, free, (list_min(list_transform(free, lambda x: (((x - start[turn % {len(SHARDS)} + 1] + {TABLE_SIZE}) * inverse[turn % {len(SHARDS)} + 1]) % {TABLE_SIZE}) * {TABLE_SIZE} + x)) % {TABLE_SIZE}) AS pick
            FROM fill, starts, inverses WHERE turn < {TABLE_SIZE})),
        slots AS (SELECT slot, (turn - 1) % {len(SHARDS)} AS shard_id FROM fill WHERE slot IS NOT NULL),
        docs AS (SELECT doc_id, source, {_HASH.format("doc_id::VARCHAR")} % {TABLE_SIZE} AS slot FROM documents)
        SELECT doc_id, source, slot, shard_id FROM docs JOIN slots USING (slot)""",
    # Words; for each item windows of twice its length, rounded up to a power of two, that overlap by half; five-word runs. Items of the table have five words or more.
    "op7_decontamination": """
        WITH i AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w,
                          regexp_extract_all(lower(regexp_extract(trim(text), '(?s)^(.*[.!?])\\s+(\\S.*)$', 2)), '[\\p{L}\\p{N}_]+') AS a FROM benchmark),
        h AS (SELECT item_id, greatest(16, pow(2, ceil(log2(len(w)))))::BIGINT AS half FROM i),
        ir AS (SELECT DISTINCT item_id, array_to_string(w[p:p + 4], ' ') AS r FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS p FROM i)),
        n AS (SELECT item_id, count(*) AS n FROM ir GROUP BY 1),
        ia AS (SELECT DISTINCT item_id, unnest(a) AS x FROM i),
        d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+') AS w FROM documents),
        dr AS (SELECT doc_id, k, p - 1 AS p, array_to_string(w[p:p + 4], ' ') AS r FROM (SELECT doc_id, w, len(w) AS k, unnest(range(1, greatest(len(w) - 3, 1))) AS p FROM d)),
        hit AS (SELECT doc_id, item_id, r, p, half, greatest(1, ceil(k / half)::BIGINT - 1) AS windows FROM dr JOIN ir USING (r) JOIN h USING (item_id)),
        v AS (SELECT *, unnest([p // half, p // half - 1]) AS j FROM hit),
        hits AS (SELECT doc_id, item_id, j, half, count(DISTINCT r) / any_value(n) AS share FROM v JOIN n USING (item_id) WHERE j >= 0 AND j < windows AND p - j * half + 5 <= 2 * half
                 GROUP BY doc_id, item_id, j, half HAVING count(DISTINCT r) >= 0.8 * any_value(n)),
        said AS (SELECT doc_id, j, item_id, count(DISTINCT x) AS k, count(DISTINCT CASE WHEN list_contains(w[j * half + 1:j * half + 2 * half], x) THEN x END) AS m
                 FROM hits JOIN d USING (doc_id) LEFT JOIN ia USING (item_id) GROUP BY ALL),
        found AS (SELECT doc_id, item_id, share FROM hits JOIN said USING (doc_id, j, item_id) WHERE m >= 0.5 * k)
        SELECT DISTINCT doc_id, item_id, max(share) OVER (PARTITION BY doc_id) AS best_overlap FROM found""",
    "op9_suffix_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
        w AS (SELECT doc_id, p, substr(x, 2 * p + 1, 100) AS s FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2 - 49)) AS p FROM d)),
        f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s),
        g AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 50 THEN 0 ELSE 1 END AS opens FROM w JOIN f USING (s) WHERE first < doc_id),
        r AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS z FROM (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM g) GROUP BY doc_id, run),
        k AS (SELECT doc_id, z AS a, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS z FROM (SELECT doc_id, a, z FROM r UNION ALL SELECT doc_id, -1, 0 FROM d)),
        kept AS (SELECT doc_id, string_agg(substr(x, 2 * a + 1, 2 * coalesce(z - a, len(x))), '' ORDER BY a) AS y FROM k JOIN d USING (doc_id) GROUP BY doc_id),
        n AS (SELECT doc_id, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans FROM r GROUP BY doc_id)
        SELECT doc_id, len(x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(y)) AS kept_sha256
        FROM d JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)""",
    # A state is the least (cost, audit, repaired text) that reaches it; a row's inserts come before its own edit.
    "op12_repair": f"""
        WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
        h AS (SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)),
                                        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS harm FROM conversations, crc),
        d AS (SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
                     CASE harm WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text,
                     unnest(range(CASE WHEN harm = 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE harm <> 0),
        n AS (SELECT *, left(role, 1) AS i, trim(text, {_BLANK}) AS bare, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS k FROM d),
        f AS (SELECT *, CASE WHEN bare = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'd' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '-' END AS fault,
                     lag(i) OVER (PARTITION BY conv_id ORDER BY k) AS before FROM n),
        r AS (SELECT *, fault IN ('b', 'd') AS must, CASE WHEN fault = 't' THEN 5 ELSE 0 END AS extra FROM f),
        none AS (SELECT {{'c': 1000000000000::BIGINT, 'a': ''::VARCHAR, 'r': ''::VARCHAR}} AS s),
        walk AS (
          SELECT conv_id, 0::BIGINT AS k, {{'c': 0::BIGINT, 'a': ''::VARCHAR, 'r': ''::VARCHAR}} AS s0, s AS s1, s AS s2, s AS s3 FROM (SELECT DISTINCT conv_id FROM conversations), none
          UNION ALL
          SELECT conv_id, k, {_edits()} FROM (
            SELECT *, {_BEST.format("q3, " + _ADD.format("p2", 5, "I", _IN_ASSISTANT))} AS p3 FROM (
              SELECT w.conv_id, r.k, r.role, r.text, r.i, r.must, r.extra::BIGINT AS extra, s0 AS p0, s1 AS p1, s3 AS q3,
                     {_BEST.format("s2, " + ", ".join(_ADD.format(s, 5, "I", _IN_USER) for s in ("s0", "s1", "s3")))} AS p2
              FROM walk w JOIN r ON r.conv_id = w.conv_id AND r.k = w.k + 1))),
        last AS (SELECT *, {_BEST.format("s0, s3, " + _ADD.format("s2", 5, "I", _IN_ASSISTANT) + ", " + _ADD.format("s1", 10, "II", _IN_USER + " || " + _IN_ASSISTANT))} AS best
                 FROM walk QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY k DESC) = 1),
        seen AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
                        count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (before || i NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id)
        SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
               best.c AS cost, best.a AS audit, sha256(substr(best.r, 2)) AS repaired_sha256
        FROM last LEFT JOIN seen USING (conv_id)""",
}
