"""DuckDB counterparts of the queries that SQL can express."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_CONTROL_TAILS = r"s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>|ROLE\]|/ROLE\]|NULL\]"


def _vector_codes(rounds: int = 2) -> str:
    """Lloyd rounds spelled out one after the other: a{i} assigns parts to the codebooks c{i}."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT vec_id, label, p.part, p.s, min({{'d': list_sum(list_transform(range(1, len(p.s) + 1), lambda j: (p.s[j] - c.s[j]) * (p.s[j] - c.s[j])))::BIGINT, 'e': c.e}}) AS m FROM p JOIN c{i} c USING (part) GROUP BY ALL)")
        if i < rounds:
            steps.append(f"m{i} AS (SELECT part, m.e AS e, j, floor(sum(s[j]) / count(*))::BIGINT AS x FROM (SELECT *, unnest(range(1, len(s) + 1)) AS j FROM a{i}) GROUP BY ALL)")
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT part, e, coalesce(n.s, c.s) AS s FROM c{i} c LEFT JOIN (SELECT part, e, list(x ORDER BY j) AS s FROM m{i} GROUP BY ALL) n USING (part, e))")
    return f"""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x)::BIGINT) AS v FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, label, part, v[part * (len(v) // 16) + 1:(part + 1) * (len(v) // 16)] AS s FROM k, range(16) w(part)),
c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id, s) - 1 AS e, s FROM p SEMI JOIN (SELECT vec_id FROM k ORDER BY vec_id LIMIT 64) f USING (vec_id)),
{", ".join(steps)},
o AS (SELECT vec_id, label, string_agg(lower(printf('%02x', m.e)), '' ORDER BY part) AS code, sum(m.d)::BIGINT AS error FROM a{rounds} GROUP BY ALL)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, (SELECT sha256(string_agg(array_to_string(s, ','), ',' ORDER BY part, e)) FROM c{rounds}) AS codebooks_sha256 FROM o
"""


SQL = {
    "op1_near_dedup": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
g AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2 HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT doc_id AS d, doc_id AS c FROM s UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.d)
SELECT doc_id, len(s) AS n_shingles, min(c) AS component_id, doc_id = min(c) AS kept FROM s JOIN r ON d = doc_id GROUP BY doc_id, len(s)
""",
    "op2_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
SELECT page_id, octet_length(b) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to, true AS intact FROM p
""",
    "op7_chat_format": rf"""
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS t FROM conversations UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
f AS (SELECT *, length(regexp_replace(t, '([<\[]\\*)({_CONTROL_TAILS})', '\1\\\2', 'g')) + CASE role WHEN 'user' THEN length('<s>[INST][/INST]') WHEN 'system' THEN length('<s><<SYS>><</SYS>>') WHEN 'assistant' THEN length('</s>')
  ELSE length('[ROLE][/ROLE]</s>') + coalesce(length(regexp_replace(role, '([<\[]\\*)({_CONTROL_TAILS})', '\1\\\2', 'g')), length('[NULL]')) END AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(coalesce(role, '') || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, t)) AS turns_sha256, coalesce(sum(length(t)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, t) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, sum(n)::BIGINT AS formatted_chars FROM f GROUP BY 1
""",
    "op9_exact_dedup": """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
""",
    "op11_histogram_shards": """
WITH tb AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda acc, k: CASE WHEN acc & 1 = 1 THEN xor(acc >> 1, 3988292384) ELSE acc >> 1 END, i::BIGINT)) AS tb),
b AS (SELECT doc_id, text, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS bs FROM documents),
k AS (SELECT doc_id, xor(list_reduce(bs, lambda acc, x: xor(acc >> 8, tb[xor(acc & 255, x) + 1]), 4294967295::BIGINT), 4294967295) AS crc, octet_length(encode(coalesce(text, ''))) + 1 AS size, ('0x' || substr(md5(coalesce(text, '')), 1, 15))::BIGINT AS k1, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS k2 FROM b, tb),
r AS (SELECT *, sum(size) OVER (ORDER BY k1, k2 ROWS UNBOUNDED PRECEDING) - size AS before, sum(size) OVER () AS total, sum(size) OVER (PARTITION BY k1) AS group_size FROM k),
g AS (SELECT *, min(before) OVER (PARTITION BY k1) AS group_before FROM r),
c AS (SELECT i, CASE WHEN least(i * total - 8 * group_before, 8 * (group_before + group_size) - i * total) <= 0.005 * total
    THEN CASE WHEN 8 * (group_before + group_size) - i * total < i * total - 8 * group_before THEN group_before + group_size ELSE group_before END
    WHEN 8 * (before + size) - i * total < i * total - 8 * before THEN before + size ELSE before END AS cut
  FROM g JOIN range(1, 8) w(i) ON 8 * before <= i * total AND i * total < 8 * (before + size)),
s AS (SELECT *, (SELECT count(*) FROM c WHERE cut <= before) AS shard FROM g)
SELECT doc_id, size::BIGINT AS size, crc AS text_crc32, 'bytes' AS law, shard::INT AS shard, row_number() OVER (PARTITION BY shard ORDER BY k1, k2) - 1 AS slot, NULL::INT AS grown_shard FROM s
""",
    "op12_vector_codes": _vector_codes(),
    "op13_fill_in_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
n AS (SELECT *, len(u) AS n, list_transform(range(4), lambda k: ('0x' || substr(h, 8 * k + 1, 8))::BIGINT) AS r FROM d),
f AS (SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 90 THEN 'plain' WHEN r[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM n),
p AS (SELECT *, array_to_string(u[:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
""",
}
