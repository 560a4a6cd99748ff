"""DuckDB SQL for the queries that SQL can express."""

#: The table of the CRC-32 of a byte, which DuckDB has no function for.
CRC_STEPS = """
WITH RECURSIVE poly(b, r, k) AS (
  SELECT range, range, 0 FROM range(256)
  UNION ALL
  SELECT b, CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END, k + 1 FROM poly WHERE k < 8
),
steps AS (SELECT list(r ORDER BY b) AS t FROM poly WHERE k = 8),
"""

OP8 = CRC_STEPS + """
bytes AS (
  SELECT doc_id, coalesce(text, '') AS text, octet_length(encode(coalesce(text, ''))) + 16 AS size FROM documents
),
crcs AS (
  SELECT doc_id, size,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, 2 * octet_length(encode(text)), 2),
          lambda i: ('0x' || substr(hex(encode(text)), i::INT + 1, 2))::BIGINT)),
        lambda a, b: xor(a >> 8, t[(xor(a, b) & 255)::INT + 1])), 4294967295) AS text_crc32
  FROM bytes, steps
),
ordered AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING) AS upto,
    sum(size) OVER () AS total, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) AS rn
  FROM crcs
),
placed AS (SELECT *, least(39, ((2 * upto - size) * 40) // (2 * total))::INT AS shard FROM ordered)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, shard,
  (rn - min(rn) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INT AS grown_shard
FROM placed
"""

OP11 = CRC_STEPS + """
distinct_changes AS (
  SELECT DISTINCT change_id, client_id, seq, op, valid_at, source, segment, city, balance FROM client_changes WHERE valid_at IS NOT NULL
),
arrivals AS (
  SELECT *, date_diff('day', DATE '1970-01-01', valid_at::DATE) + coalesce(
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, 2 * octet_length(encode(change_id::VARCHAR)), 2),
          lambda i: ('0x' || substr(hex(encode(change_id::VARCHAR)), i::INT + 1, 2))::BIGINT)),
        lambda a, b: xor(a >> 8, t[(xor(a, b) & 255)::INT + 1])), 4294967295) % 4, 0) AS d
  FROM distinct_changes, steps
),
ch AS (SELECT *, greatest(0, least(9, floor((d - 19723) * 10 / 152)))::INT AS cb FROM arrivals),
sl AS (
  SELECT *, row_number() OVER () AS r,
    coalesce(greatest(0, least(9, floor((date_diff('day', DATE '1970-01-01', arrived_at::DATE) - 19723) * 10 / 152))), 0)::INT AS sb
  FROM sales
),
marks AS (
  SELECT range::INT AS b, (SELECT max(sold_at) FROM sl WHERE sb < range) - INTERVAL 36 HOUR AS ws, (SELECT max(valid_at) FROM ch WHERE cb < range) - INTERVAL 36 HOUR AS wc
  FROM range(10)
),
h AS (SELECT b, wc, CASE WHEN ws IS NOT NULL AND wc IS NOT NULL THEN least(ws, wc) END AS h FROM marks),
late AS (SELECT change_id, cb FROM ch JOIN h ON b = cb WHERE valid_at < wc),
v AS (SELECT ch.* FROM ch JOIN h ON b = cb WHERE client_id IS NOT NULL AND (wc IS NULL OR valid_at >= wc)),
em AS (
  SELECT sl.r, any_value(sl.sale_id) AS sale_id, any_value(sl.client_id) AS client_id, any_value(sl.sold_at) AS sold_at, coalesce(min(b), 10) AS e
  FROM sl LEFT JOIN h ON b >= sb AND (sold_at IS NULL OR sold_at < h.h)
  GROUP BY sl.r
),
asked AS (SELECT DISTINCT client_id, e, h.h AS hp FROM em LEFT JOIN h ON b = e - 1),
seen AS (SELECT asked.e, v.*, coalesce(cb < e AND valid_at <= hp, false) AS old FROM asked JOIN v USING (client_id) WHERE cb <= e),
kept AS (
  SELECT * FROM seen
  QUALIFY NOT old OR row_number() OVER (PARTITION BY client_id, e, old
    ORDER BY valid_at DESC, seq DESC NULLS LAST, change_id DESC NULLS LAST, op DESC NULLS LAST, balance DESC NULLS LAST) = 1
),
held AS (SELECT client_id, e, count(*) AS n FROM kept GROUP BY ALL),
picked AS (
  SELECT em.r, k.change_id, k.balance, k.op
  FROM em JOIN kept k ON k.client_id = em.client_id AND k.e = em.e AND k.valid_at <= em.sold_at
  QUALIFY row_number() OVER (PARTITION BY em.r
    ORDER BY k.valid_at DESC, k.seq DESC NULLS LAST, k.change_id DESC NULLS LAST, k.op DESC NULLS LAST, k.balance DESC NULLS LAST) = 1
)
SELECT 'sale' AS rec, sale_id AS id, em.e::BIGINT AS batch, coalesce(held.n, 0)::BIGINT AS n_held, change_id, floor(100 * balance + 0.5)::BIGINT AS balance_cents, op
FROM em LEFT JOIN held ON held.client_id = em.client_id AND held.e = em.e LEFT JOIN picked USING (r)
UNION ALL
SELECT 'late', change_id, cb::BIGINT, NULL, NULL, NULL, NULL FROM late
"""

OP12 = """
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
    sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents
),
drawn AS (
  SELECT *, len(u) AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(u) + 1) AS x, ('0x' || substr(h, 9, 8))::BIGINT % (len(u) + 1) AS y,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 90 THEN 'plain'
      WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM units
),
parts AS (
  SELECT doc_id, text, n, form, array_to_string(u[1:least(x, y)], '') AS p, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS m,
    array_to_string(u[greatest(x, y) + 1:n], '') AS s
  FROM drawn
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(p || m || s) AS restored_sha256
FROM parts
"""

ORACLES: dict[str, str] = {"op8_shards": OP8, "op11_valid_time": OP11, "op12_infill": OP12}
