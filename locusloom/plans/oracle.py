"""The same results in DuckDB's SQL, written from the definitions: bases and breakpoints by joins and window functions."""

from __future__ import annotations

PRELUDE: list[tuple[str, str]] = [
    ("frag", """SELECT event_id, 'r' || CAST(event_id AS VARCHAR) AS qname, event_type AS chrom, 1 + user_id * 1000 + (event_id * 7919) % 600 AS pos,
  CASE WHEN event_id % 50 = 1 THEN 20000 ELSE 150 + CAST(floor(value) AS BIGINT) % 350 END AS flen,
  CASE event_id % 3 WHEN 0 THEN '+' WHEN 1 THEN '-' END AS strand, CAST(1 + event_id % 2 AS INTEGER) AS nh,
  CASE WHEN event_id % 4 = 0 THEN '44M112N32M' WHEN event_id % 7 = 0 THEN '5S71M' WHEN event_id % 11 = 0 THEN '30M2D46M' ELSE '76M' END AS cigar,
  event_id % 5 <> 0 AS is_paired FROM events"""),
    ("reads", """SELECT 2 * event_id AS line_no, qname, chrom, pos, cigar, CASE WHEN is_paired THEN chrom END AS mate_chrom,
  CASE WHEN is_paired THEN pos + flen - 76 END AS mate_pos, strand, nh FROM frag
  UNION ALL SELECT 2 * event_id + 1, qname, chrom, pos + flen - 76, '76M', chrom, pos, strand, nh FROM frag WHERE is_paired"""),
    ("records", r"""SELECT line_no, qname, CAST(CASE WHEN line_no % 13 = 0 THEN 4 ELSE 0 END + CASE WHEN line_no % 11 = 0 THEN 8 ELSE 0 END + CASE WHEN line_no % 2 = 0 THEN 64 ELSE 128 END AS INTEGER) AS flag,
  CASE WHEN line_no % 17 = 0 THEN '*' ELSE chrom END AS rname, CASE WHEN line_no % 17 = 0 THEN 0 ELSE pos END AS pos, cigar,
  CASE WHEN mate_pos IS NULL THEN '*' ELSE '=' END AS rnext, coalesce(mate_pos, 0) AS pnext, nh, strand, mate_pos FROM reads"""),
    ("annot", """SELECT p_partkey AS transcript_id, chrom, unnest([0, 1]) AS exon, unnest([pos - 10, pos + 156]) AS s, unnest([pos + 44, pos + 301]) AS e
  FROM part JOIN frag ON event_id = p_partkey * 4"""),
    ("annot2", """SELECT transcript_id, chrom, exon, s + transcript_id % 5 AS s, e - transcript_id % 3 AS e FROM annot WHERE NOT (exon = 1 AND transcript_id % 7 = 0)"""),
    ("ops", r"""SELECT line_no, pos, unnest(range(len(regexp_extract_all(cigar, '\d+')))) AS i, CAST(unnest(regexp_extract_all(cigar, '\d+')) AS BIGINT) AS n,
  unnest(regexp_extract_all(cigar, '[MIDNSHP=X]')) AS op FROM reads"""),
    ("placed", """SELECT *, pos + coalesce(sum(CASE WHEN op IN ('M', 'D', 'N', '=', 'X') THEN n ELSE 0 END) OVER (PARTITION BY line_no ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spot,
  sum(CASE WHEN op = 'N' THEN 1 ELSE 0 END) OVER (PARTITION BY line_no ORDER BY i) AS seg FROM ops"""),
    ("blk", """SELECT line_no, seg, CAST(min(spot) FILTER (WHERE op IN ('M', '=', 'X')) AS BIGINT) AS s, CAST(max(spot + n) FILTER (WHERE op IN ('M', '=', 'X', 'D')) AS BIGINT) AS e
  FROM placed GROUP BY line_no, seg HAVING min(spot) FILTER (WHERE op IN ('M', '=', 'X')) IS NOT NULL"""),
    ("gaps", """SELECT * FROM (SELECT line_no, e AS s, lead(s) OVER (PARTITION BY line_no ORDER BY s) AS e FROM blk) WHERE e IS NOT NULL"""),
    ("span", """SELECT line_no, min(s) AS s, max(e) AS e, sum(e - s) AS len, count(*) AS n FROM blk GROUP BY line_no"""),
    ("ext", """SELECT r.*, span.s, span.e AS own_e, greatest(span.e, CASE WHEN mate_chrom = chrom AND mate_pos > pos AND mate_pos - pos < 5000 THEN mate_pos ELSE span.e END) AS e
  FROM reads r JOIN span USING (line_no)"""),
    ("fresh", """SELECT *, CASE WHEN coalesce(s > max(e) OVER (PARTITION BY chrom ORDER BY s, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 50, true) THEN 1 ELSE 0 END AS new FROM ext"""),
    ("rows_", """SELECT *, CAST(sum(new) OVER (PARTITION BY chrom ORDER BY s, line_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS bundle_id FROM fresh"""),
    ("bund", """SELECT chrom, bundle_id, min(s) AS s, max(e) AS e FROM rows_ GROUP BY chrom, bundle_id"""),
    ("bps", """SELECT chrom, bundle_id, s AS bp FROM bund UNION SELECT chrom, bundle_id, e FROM bund
  UNION SELECT chrom, bundle_id, unnest([gaps.s, gaps.e]) FROM rows_ JOIN gaps USING (line_no)"""),
    ("sub", """SELECT * FROM (SELECT chrom, bundle_id, CAST(row_number() OVER w - 1 AS INTEGER) AS subexon_id, bp AS s, lead(bp) OVER w AS e FROM bps
  WINDOW w AS (PARTITION BY chrom, bundle_id ORDER BY bp)) WHERE e IS NOT NULL"""),
    ("inc", """SELECT blk.line_no, sub.chrom, sub.bundle_id, subexon_id, greatest(blk.s, sub.s) AS s, least(blk.e, sub.e) AS e, sub.s AS sub_s, sub.e AS sub_e
  FROM blk JOIN rows_ USING (line_no) JOIN sub ON sub.chrom = rows_.chrom AND sub.bundle_id = rows_.bundle_id AND blk.s < sub.e AND blk.e > sub.s"""),
    ("rpath", """SELECT line_no, list(subexon_id ORDER BY subexon_id) AS path FROM (SELECT DISTINCT line_no, subexon_id FROM inc) GROUP BY line_no"""),
    ("numbered", """SELECT *, row_number() OVER (PARTITION BY qname, chrom, pos, mate_chrom, mate_pos ORDER BY line_no) AS rn FROM reads WHERE mate_pos IS NOT NULL"""),
    ("pairs", """SELECT a.line_no AS line_a, b.line_no AS line_b FROM numbered a JOIN numbered b ON a.qname = b.qname AND a.chrom = b.mate_chrom AND a.mate_chrom = b.chrom
  AND a.pos = b.mate_pos AND a.mate_pos = b.pos AND a.rn = b.rn AND (a.chrom, a.pos) < (b.chrom, b.pos)"""),
    ("turned", """SELECT CASE WHEN t THEN y ELSE x END AS line_a, CASE WHEN t THEN x ELSE y END AS line_b FROM (
  SELECT a.line_no AS x, b.line_no AS y, (a.own_e, a.s, a.line_no) > (b.own_e, b.s, b.line_no) AS t FROM pairs JOIN rows_ a ON a.line_no = line_a JOIN rows_ b ON b.line_no = line_b)"""),
    ("inner_a", """SELECT DISTINCT line_a FROM turned JOIN gaps ON gaps.line_no = line_a JOIN blk ON blk.line_no = line_b AND blk.s < gaps.e AND blk.e > gaps.s"""),
    ("inner_b", """SELECT DISTINCT line_a FROM turned JOIN gaps ON gaps.line_no = line_b JOIN blk ON blk.line_no = line_a AND blk.s < gaps.e AND blk.e > gaps.s"""),
    ("coded", """SELECT line_a, line_b, CAST(CASE WHEN (a.s < b.s AND a.own_e > b.own_e) OR (b.s < a.s AND b.own_e > a.own_e) THEN 3
  WHEN line_a IN (SELECT line_a FROM inner_a) THEN 1 WHEN line_a IN (SELECT line_a FROM inner_b) THEN 2 ELSE 0 END AS INTEGER) AS code,
  a.chrom, a.bundle_id, b.bundle_id AS bundle_id_b, pa.path AS path_a, pb.path AS path_b, coalesce(a.strand, b.strand) AS strand, least(a.nh, b.nh) AS nh
  FROM turned JOIN rows_ a ON a.line_no = line_a JOIN rows_ b ON b.line_no = line_b JOIN rpath pa ON pa.line_no = line_a JOIN rpath pb ON pb.line_no = line_b"""),
    ("frags", """SELECT line_a AS frag, line_a, line_b, chrom, bundle_id, bundle_id_b, path_a, path_b,
  CASE WHEN code = 0 THEN list_concat(list_filter(path_a, lambda x: x < path_b[1]), path_b) ELSE list_concat(path_a, path_b) END AS path, code, strand, nh, bundle_id <> bundle_id_b AS crossing FROM coded
  UNION ALL SELECT line_no, line_no, NULL, chrom, bundle_id, bundle_id, path, NULL, path, 0, strand, nh, false FROM rows_ JOIN rpath USING (line_no)
  WHERE line_no NOT IN (SELECT line_a FROM pairs UNION ALL SELECT line_b FROM pairs)"""),
    ("whole", """SELECT *, CASE WHEN crossing THEN array_to_string(path_a, ',') || '/' || bundle_id_b || '/' || array_to_string(path_b, ',') ELSE array_to_string(path, ',') END AS p,
  CASE WHEN crossing THEN list_concat(path_a, path_b) ELSE path END AS walk FROM frags"""),
    ("el0", """SELECT frag, line_a, line_b, chrom, bundle_id, p, strand, nh, code, crossing, na, k, subexon_id, CASE WHEN crossing AND k >= na THEN bundle_id_b ELSE bundle_id END AS eb
  FROM (SELECT *, len(path_a) AS na, CAST(unnest(range(len(walk))) AS INTEGER) AS k, unnest(walk) AS subexon_id FROM whole)"""),
    ("el", """SELECT el0.*, sub.s, sub.e, CASE WHEN code = 0 AND NOT crossing THEN 'both' WHEN k < na THEN 'a' ELSE 'b' END AS side,
  coalesce(sum(sub.e - sub.s) OVER (PARTITION BY frag ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off, sum(sub.e - sub.s) OVER (PARTITION BY frag) AS total
  FROM el0 JOIN sub ON sub.chrom = el0.chrom AND sub.bundle_id = eb AND sub.subexon_id = el0.subexon_id"""),
    ("loc", """SELECT el.chrom, el.bundle_id, p, strand, nh, frag, k, el.s AS es, el.e AS ee, off + inc.s - el.s AS s, off + inc.e - el.s AS e, inc.s = el.s AS starts, inc.e = el.e AS ends
  FROM el JOIN inc ON inc.subexon_id = el.subexon_id AND inc.bundle_id = eb AND ((side <> 'b' AND inc.line_no = line_a) OR (side <> 'a' AND inc.line_no = line_b))"""),
    ("lens", """SELECT chrom, bundle_id, p, strand, nh, 'unpaired' AS kind, len FROM whole JOIN span ON span.line_no = line_a WHERE line_b IS NULL
  UNION ALL SELECT chrom, bundle_id, p, strand, nh, 'left', len FROM whole JOIN span ON span.line_no = line_a WHERE line_b IS NOT NULL
  UNION ALL SELECT chrom, bundle_id, p, strand, nh, 'right', len FROM whole JOIN span ON span.line_no = line_b
  UNION ALL SELECT w.chrom, w.bundle_id, w.p, w.strand, w.nh, 'paired', total - (a.s - low) - (high - b.e) FROM whole w JOIN span a ON a.line_no = line_a JOIN span b ON b.line_no = line_b
    JOIN (SELECT frag, max(total) AS total, min_by(s, k) AS low, max_by(e, k) AS high FROM el GROUP BY frag) x ON x.frag = w.frag"""),
    ("hist", """SELECT chrom, bundle_id, p AS path, strand, nh, kind, CAST(len AS BIGINT) AS len, count(*) AS freq FROM lens GROUP BY ALL"""),
    ("change", """SELECT chrom, spot, sum(w) AS w FROM (SELECT chrom, unnest([blk.s, blk.e]) AS spot, unnest([1.0::DOUBLE / nh, -1.0::DOUBLE / nh]) AS w FROM blk JOIN reads USING (line_no)) GROUP BY chrom, spot HAVING sum(w) <> 0"""),
    ("depth", """SELECT * FROM (SELECT chrom, spot AS s, lead(spot) OVER w AS e, sum(w) OVER w AS v FROM change WINDOW w AS (PARTITION BY chrom ORDER BY spot)) WHERE e IS NOT NULL AND v > 1e-9"""),
    ("juncs", """SELECT DISTINCT chrom, s, e FROM (SELECT chrom, e AS s, lead(s) OVER (PARTITION BY transcript_id, chrom ORDER BY s, e) AS e FROM annot) WHERE e IS NOT NULL"""),
    ("tspan", """SELECT transcript_id, chrom, min(s) AS s, max(e) AS e, count(*) AS n, sum(e - s) AS len FROM annot GROUP BY ALL"""),
    ("tspan2", """SELECT transcript_id, chrom, min(s) AS s, max(e) AS e, count(*) AS n, sum(e - s) AS len FROM annot2 GROUP BY ALL"""),
    ("tp", """SELECT x.transcript_id AS a, y.transcript_id AS b, x.n AS na, y.n AS nb, x.len AS la, y.len AS lb, i.exon AS i, j.exon AS j, i.s AS s1, i.e AS e1, j.s AS s2, j.e AS e2,
  1.0::DOUBLE - least(abs(i.s - j.s), 10) / 20.0::DOUBLE - least(abs(i.e - j.e), 10) / 20.0::DOUBLE AS x
  FROM tspan x JOIN tspan2 y ON x.chrom = y.chrom AND x.s < y.e AND x.e > y.s JOIN annot i ON i.transcript_id = x.transcript_id JOIN annot2 j ON j.transcript_id = y.transcript_id"""),
    ("quant", """SELECT transcript_id, coalesce(x, 0) AS x, coalesce(y, 0) AS y FROM (SELECT CASE WHEN p_partkey % 10 = 3 THEN -p_partkey ELSE p_partkey END AS transcript_id, CAST(p_retailprice AS DOUBLE) AS x FROM part)
  FULL JOIN (SELECT CASE WHEN p_partkey % 10 = 7 THEN -p_partkey ELSE p_partkey END AS transcript_id, CAST(p_retailprice AS DOUBLE) * 1.25::DOUBLE AS y FROM part) USING (transcript_id)"""),
]

REGION = "chrom = 'view' AND s < 60000 AND e > 20000"
FINAL: dict[str, str] = {
    "cigar_blocks": "SELECT line_no, CAST(row_number() OVER (PARTITION BY line_no ORDER BY s) - 1 AS INTEGER) AS block, s, e FROM blk",
    "cigar_ref_length": "SELECT line_no, CAST(sum(CASE WHEN op IN ('M', 'D') THEN n ELSE 0 END) AS BIGINT) AS n FROM ops GROUP BY line_no",
    "flag_bits": "SELECT line_no, flag & 4 <> 0 AS unmapped, flag & 8 <> 0 AS mate_unmapped, flag & 64 <> 0 AS first_mate, flag & 128 <> 0 AS second_mate FROM records",
    "tag_extract": "SELECT line_no, strand, nh FROM records",
    "rnext_resolve": "SELECT line_no, CASE WHEN rnext = '=' THEN rname END AS mate_chrom FROM records",
    "chrom_offsets": """SELECT chrom, chrom_len, CAST(coalesce(sum(chrom_len + 1) OVER (ORDER BY chrom ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS BIGINT) AS start
  FROM (SELECT DISTINCT event_type AS chrom, (SELECT max(user_id) + 1 FROM events) * 1000 + 25000 AS chrom_len FROM events)""",
    "sam_filter_mapped": "SELECT line_no, qname, rname, pos FROM records WHERE rname <> '*' AND flag & 4 = 0",
    "sortedness_check": "SELECT line_no, rname, pos FROM (SELECT *, lag(pos) OVER (PARTITION BY rname ORDER BY line_no) AS b FROM records) WHERE pos < b",
    "strip_unpaired_tag": "SELECT line_no, rname, concat_ws(chr(9), 'NH:i:' || nh, 'XS:A:' || strand) AS tags FROM records WHERE NOT (rname = '*' AND pos = 0)",
    "remove_pairing": "SELECT line_no, CASE WHEN flag & 8 <> 0 THEN 0 ELSE flag END AS flag, CASE WHEN flag & 8 <> 0 THEN '*' ELSE rnext END AS rnext, CASE WHEN flag & 8 <> 0 THEN 0 ELSE pnext END AS pnext, CAST(0 AS BIGINT) AS tlen FROM records",
    "filter_by_length": "SELECT line_no, any_value(cigar) AS cigar FROM ops JOIN reads USING (line_no) GROUP BY line_no HAVING sum(CASE WHEN op IN ('M', 'D') THEN n ELSE 0 END) = 78",
    "frag_len_hist": "SELECT mate_pos - pos AS len, count(*) AS freq FROM reads WHERE mate_chrom = chrom GROUP BY 1",
    "frag_len_cutoff": """SELECT n, round(m, 6) AS mean, round(sd, 6) AS sd, CAST(floor(m + 0.125::DOUBLE * sd) AS BIGINT) AS cutoff FROM (
  SELECT any_value(c.n) AS n, any_value(m) AS m, sqrt(sum((mate_pos - pos - m) ** 2) / any_value(c.n)) AS sd
  FROM reads, (SELECT count(*) AS n, sum(CASE WHEN mate_pos >= pos THEN mate_pos - pos ELSE 0 END)::DOUBLE / count(*) AS m FROM reads) c WHERE mate_chrom = chrom)""",
    "long_fragment_share": "SELECT round(100.0::DOUBLE * count(*) FILTER (WHERE mate_pos - pos > 5000) / count(*), 6) AS percent FROM reads",
    "mate_pairs": "SELECT * FROM pairs",
    "unmatched_reads": """WITH u AS (SELECT * REPLACE (CASE WHEN line_no % 19 = 3 THEN qname || 'x' ELSE qname END AS qname) FROM reads)
  SELECT a.line_no, a.qname FROM u a WHERE a.mate_pos IS NOT NULL AND NOT EXISTS (SELECT 1 FROM u b WHERE b.qname = a.qname AND b.line_no <> a.line_no AND b.pos = a.mate_pos AND b.mate_pos = a.pos)""",
    "diff_strand_pairs": """SELECT * FROM (SELECT line_a, line_b, CASE WHEN line_a % 6 = 1 THEN '-' ELSE a.strand END AS strand_a, CASE WHEN line_b % 6 = 1 THEN '-' ELSE b.strand END AS strand_b
  FROM pairs JOIN reads a ON a.line_no = line_a JOIN reads b ON b.line_no = line_b) WHERE strand_a <> strand_b""",
    "infer_xs": """SELECT r.line_no, CASE WHEN r.line_no % 2 = 0 THEN r.strand ELSE m.strand END AS strand FROM reads r LEFT JOIN pairs ON line_b = r.line_no LEFT JOIN reads m ON m.line_no = line_a""",
    "enumerate_pairs": """WITH l AS (SELECT 'g' || (line_no // 6) AS g, line_no, pos, mate_pos FROM reads WHERE mate_pos IS NOT NULL AND line_no % 2 = 0),
  r AS (SELECT CASE WHEN line_no % 10 = 1 THEN 'h' || line_no ELSE 'g' || (line_no // 6) END AS g, line_no, pos, mate_pos FROM reads WHERE mate_pos IS NOT NULL AND line_no % 2 = 1),
  x AS (SELECT l.g, na, nb, lp = rp AS one FROM (SELECT g, count(*) AS na, list([pos, mate_pos] ORDER BY pos, mate_pos) AS lp FROM l GROUP BY g) l
    JOIN (SELECT g, count(*) AS nb, list([mate_pos, pos] ORDER BY mate_pos, pos) AS rp FROM r GROUP BY g) r USING (g))
  SELECT g AS qname, l.line_no AS line_a, CAST(NULL AS BIGINT) AS line_b, na AS nh FROM l JOIN x USING (g) WHERE one
  UNION ALL SELECT g, NULL, r.line_no, nb FROM r JOIN x USING (g) WHERE one
  UNION ALL SELECT x.g, l.line_no, r.line_no, na * nb FROM x JOIN l USING (g) JOIN r USING (g) WHERE NOT one""",
    "discordance_class": "SELECT line_a, line_b, code FROM coded",
    "bundle_of_read": "SELECT line_no, chrom, bundle_id FROM rows_",
    "bundle_ranges": "SELECT chrom, bundle_id, s, e FROM bund",
    "bundles_in_range": f"SELECT chrom, s, e FROM bund WHERE {REGION}",
    "bundle_stats": "SELECT count(*) AS bundles, min(e - s) AS shortest, max(e - s) AS longest, round(avg(e - s), 6) AS mean_length FROM bund",
    "genes_raw": """WITH g AS (SELECT chrom, s, CASE WHEN mate_chrom = chrom AND mate_pos > pos THEN mate_pos ELSE own_e END AS e, line_no FROM ext),
  f AS (SELECT *, CASE WHEN coalesce(s > max(e) OVER (PARTITION BY chrom ORDER BY s, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 50, true) THEN 1 ELSE 0 END AS new FROM g),
  i AS (SELECT *, sum(new) OVER (PARTITION BY chrom ORDER BY s, line_no ROWS UNBOUNDED PRECEDING) AS id FROM f) SELECT chrom, min(s) AS s, max(e) AS e FROM i GROUP BY chrom, id""",
    "breakpoints": "SELECT * FROM bps",
    "breakpoints_annotated": "SELECT * FROM bps UNION SELECT chrom, bundle_id, p FROM bund JOIN (SELECT chrom, unnest([s, e]) AS p FROM annot) USING (chrom) WHERE p > s AND p <= e",
    "subexons": "SELECT chrom, bundle_id, subexon_id, s, e FROM sub",
    "subexon_prefix": "SELECT *, CAST(coalesce(sum(e - s) OVER (PARTITION BY chrom, bundle_id ORDER BY subexon_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM sub",
    "read_subexons": "SELECT line_no, subexon_id, CAST(sum(e - s) AS BIGINT) AS covered FROM inc GROUP BY line_no, subexon_id",
    "read_paths": "SELECT line_no, bundle_id, array_to_string(path, ',') AS path FROM rpath JOIN rows_ USING (line_no)",
    "fragment_paths": "SELECT frag, line_b, chrom, bundle_id, p AS path, strand, nh FROM whole WHERE NOT crossing",
    "cross_bundle_pairs": "SELECT line_a, line_b, bundle_id, bundle_id_b, array_to_string(path_a, ',') AS path_a, array_to_string(path_b, ',') AS path_b FROM frags WHERE crossing",
    "bucket_sizes": "SELECT chrom, bundle_id, p AS path, strand, nh, count(*) FILTER (WHERE line_b IS NULL) AS n_unpaired, count(*) FILTER (WHERE line_b IS NOT NULL) AS n_paired FROM whole WHERE NOT crossing GROUP BY ALL",
    "cross_buckets": "SELECT chrom, bundle_id, array_to_string(path_a, ',') AS path_a, bundle_id_b, array_to_string(path_b, ',') AS path_b, strand, nh, count(*) AS n FROM frags WHERE crossing GROUP BY ALL",
    "bucket_unpaired_lens": "SELECT * FROM hist WHERE kind = 'unpaired'",
    "bucket_paired_lens": "SELECT * FROM hist WHERE kind = 'paired'",
    "bucket_left_right_lens": "SELECT * FROM hist WHERE kind IN ('left', 'right')",
    "bucket_coverage_rle": """WITH c AS (SELECT chrom, bundle_id, p, strand, nh, spot, sum(w) AS w FROM (SELECT chrom, bundle_id, p, strand, nh, unnest([s, e]) AS spot, unnest([1, -1]) AS w FROM loc) GROUP BY ALL HAVING sum(w) <> 0),
  r AS (SELECT chrom, bundle_id, p AS path, strand, nh, spot AS s, lead(spot) OVER w AS e, sum(w) OVER w AS v FROM c WINDOW w AS (PARTITION BY chrom, bundle_id, p, strand, nh ORDER BY spot))
  SELECT chrom, bundle_id, path, strand, nh, CAST(s AS BIGINT) AS s, CAST(e AS BIGINT) AS e, CAST(v AS BIGINT) AS v FROM r WHERE e IS NOT NULL AND v > 0""",
    "bucket_elements": "SELECT DISTINCT chrom, bundle_id, p AS path, strand, nh, k, subexon_id, eb AS bundle_e, s, e, CAST(off AS BIGINT) AS off, CAST(total AS BIGINT) AS total FROM el",
    "buckets_in_range": f"SELECT DISTINCT chrom, bundle_id, p AS path, strand, nh FROM el WHERE {REGION}",
    "coverage_from_buckets": "SELECT chrom, s, e, round(v, 6) AS v FROM depth",
    "longest_read_of_bundle": "SELECT chrom, bundle_id, CAST(max(span.len) AS BIGINT) AS longest FROM rows_ JOIN span USING (line_no) GROUP BY chrom, bundle_id",
    "duplicate_reads": "SELECT chrom, bundle_id, s, own_e AS e, count(*) AS n FROM rows_ GROUP BY ALL",
    "coverage_segments": "SELECT chrom, s, e, round(v, 6) AS v FROM depth",
    "coverage_region": f"SELECT greatest(s, 20000) AS s, least(e, 60000) AS e, round(v, 6) AS v FROM depth WHERE {REGION}",
    "coverage_dense_region": "SELECT i, round(coalesce(v, 0), 6) AS v FROM range(2000) t(i) LEFT JOIN (SELECT * FROM depth WHERE chrom = 'view') ON s <= 20000 + i AND e > 20000 + i",
    "coverage_point": "SELECT chrom, round(v, 6) AS v FROM depth WHERE s <= 20300 AND e > 20300",
    "coverage_range_sum": f"SELECT round(sum((least(e, 60000) - greatest(s, 20000)) * v), 6) AS total, CAST(sum(least(e, 60000) - greatest(s, 20000)) AS BIGINT) AS covered FROM depth WHERE {REGION}",
    "rebuilt_coverage": "@bucket_coverage_rle",
    "sam_text_records": "SELECT qname, flag, rname, pos, cigar, rnext, pnext, concat_ws(chr(9), 'NH:i:' || nh, 'XS:A:' || strand, CASE WHEN mate_pos IS NULL THEN 'YT:Z:UP' END) AS tags FROM records",
    "sam_text_reads": """SELECT qname, rname AS chrom, pos, cigar, CASE WHEN rnext = '=' AND flag & 8 = 0 THEN rname END AS mate_chrom, CASE WHEN rnext = '=' AND flag & 8 = 0 THEN pnext END AS mate_pos, strand, nh
  FROM records WHERE rname <> '*' AND flag & 4 = 0""",
    "sam_text_header": "@store_chroms",
    "store_chroms": """SELECT chrom, chrom_len, CAST(row_number() OVER (ORDER BY chrom) - 1 AS BIGINT) AS ord FROM (SELECT DISTINCT event_type AS chrom, (SELECT max(user_id) + 1 FROM events) * 1000 + 25000 AS chrom_len FROM events)""",
    "gtf_text_exons": "SELECT CAST(transcript_id AS VARCHAR) AS transcript_id, chrom, CAST(exon AS INTEGER) AS exon, s, e FROM annot",
    "gtf_text_quantities": "SELECT DISTINCT CAST(transcript_id AS VARCHAR) AS transcript_id, round(transcript_id * 0.25::DOUBLE, 6) AS fpkm FROM annot",
    "profile_bounds": "SELECT DISTINCT chrom, s + 10 AS s, e + 10 AS e, 'CDS' AS kind FROM annot",
    "log_peak": "SELECT max(event_id * 7919 % 10007) AS peak FROM events",
    "store_bundles": "@bundles_in_range",
    "store_coverage": "@coverage_region",
    "store_exon_counts": "@exon_counts",
    "store_junction_counts": "@junction_counts",
    "store_pairs_in_region": "@pairs_in_region",
    "store_sam_lines": "@sam_lines",
    "store_decompress": """WITH c AS (SELECT chrom, spot, sum(w) AS w FROM (SELECT chrom, unnest([blk.s, blk.e]) AS spot, unnest([1, -1]) AS w FROM blk JOIN reads USING (line_no)) GROUP BY ALL HAVING sum(w) <> 0),
  r AS (SELECT chrom, spot AS s, lead(spot) OVER w AS e, sum(w) OVER w AS v FROM c WINDOW w AS (PARTITION BY chrom ORDER BY spot)) SELECT chrom, s, e, CAST(v AS DOUBLE) AS v FROM r WHERE e IS NOT NULL AND v > 0""",
    "run_length_vectors": """WITH d AS (SELECT p_partkey, list_transform(range(12), lambda i: (p_partkey + i * i) % 5) AS x FROM part)
  SELECT p_partkey, CAST(1 + len(list_filter(range(2, 13), lambda i: x[i] <> x[i - 1])) AS BIGINT) AS runs, array_to_string(x, ',') AS dense, x[8] AS at7,
  CAST(list_sum(x[4:8]) AS BIGINT) AS sum38, array_to_string(list_concat(x[1:3], list_transform(x[4:8], lambda v: v + 2), x[9:12]), ',') AS added FROM d""",
    "bytes_needed": "SELECT line_no, CAST(greatest(1, ceil(length(ltrim(bin(pos), '0')) / 8.0)) AS INTEGER) AS n FROM reads",
    "reads_in_region": "SELECT DISTINCT line_no, qname, pos FROM reads JOIN blk USING (line_no) WHERE chrom = 'view' AND s < 60000 AND e > 20000",
    "pairs_in_region": "SELECT DISTINCT line_a, line_b FROM pairs JOIN reads ON reads.line_no = line_a JOIN blk ON blk.line_no IN (line_a, line_b) WHERE chrom = 'view' AND s < 60000 AND e > 20000",
    "gtf_exons": "SELECT DISTINCT chrom, s, e FROM annot",
    "gtf_junctions": "SELECT * FROM juncs",
    "exon_counts": """WITH mean AS (SELECT chrom, bundle_id, p, strand, nh, avg(len) AS m FROM lens WHERE kind <> 'paired' GROUP BY ALL),
  tagged AS (SELECT unnest([line_a, line_b]) AS line_no, w.nh, m FROM whole w JOIN mean ON mean.chrom = w.chrom AND mean.bundle_id = w.bundle_id AND mean.p = w.p AND mean.strand IS NOT DISTINCT FROM w.strand AND mean.nh = w.nh)
  SELECT x.chrom, x.s, x.e, round(sum((least(x.e, blk.e) - greatest(x.s, blk.s)) / (m * t.nh)), 6) AS x FROM tagged t JOIN blk USING (line_no) JOIN reads USING (line_no)
  JOIN (SELECT DISTINCT chrom, s, e FROM annot) x ON x.chrom = reads.chrom AND x.s < blk.e AND x.e > blk.s GROUP BY x.chrom, x.s, x.e""",
    "junction_counts": """WITH g AS (SELECT chrom, bundle_id, p, strand, nh, k, any_value(es) AS s, any_value(ee) AS e, count(*) FILTER (WHERE ends) AS l, count(*) FILTER (WHERE starts) AS f FROM loc GROUP BY ALL)
  SELECT a.chrom, a.e AS s, b.s AS e, round(sum(least(a.l, b.f) / a.nh::DOUBLE), 6) AS x FROM g a JOIN g b ON a.chrom = b.chrom AND a.bundle_id = b.bundle_id AND a.p = b.p AND a.strand IS NOT DISTINCT FROM b.strand
  AND a.nh = b.nh AND b.k = a.k + 1 JOIN juncs j ON j.chrom = a.chrom AND j.s = a.e AND j.e = b.s GROUP BY a.chrom, a.e, b.s HAVING sum(least(a.l, b.f)) > 0""",
    "tophat_records": """SELECT r.qname, r.flag, r.rname, r.pos, r.rnext, r.pnext, concat_ws(chr(9), 'NH:i:' || r.nh, 'XS:A:' || r.strand, CASE WHEN r.mate_pos IS NULL THEN 'YT:Z:UP' END) AS tags FROM records r""",
    "hisat_records": """WITH x AS (SELECT * REPLACE ('g' || (line_no // 6) AS qname), line_no % 2 AS side, concat_ws(chr(9), 'NH:i:' || nh, 'XS:A:' || strand) AS tags0, 'XS:A:' || strand AS rest FROM records WHERE NOT (rname = '*' AND pos = 0)),
  l AS (SELECT qname, count(*) AS na, list([pos, pnext] ORDER BY pos, pnext) AS lp FROM x WHERE side = 0 GROUP BY qname), r AS (SELECT qname, count(*) AS nb, list([pnext, pos] ORDER BY pnext, pos) AS rp FROM x WHERE side = 1 GROUP BY qname),
  n AS (SELECT qname, na, nb, lp = rp AS one FROM l JOIN r USING (qname)),
  y AS (SELECT x.qname, flag, rname, pos, rnext, pnext, strand, CASE WHEN one THEN concat_ws(chr(9), 'NH:i:' || (CASE WHEN side = 0 THEN na ELSE nb END), rest) ELSE tags0 END AS tags, coalesce(one, false) AS one FROM x LEFT JOIN n USING (qname) WHERE one IS NULL OR one
    UNION ALL SELECT a.qname, a.flag, a.rname, a.pos, CASE WHEN a.rname = b.rname THEN '=' ELSE b.rname END, b.pos, a.strand, concat_ws(chr(9), 'NH:i:' || na * nb, 'XS:A:' || coalesce(a.strand, b.strand)), NULL FROM x a JOIN x b ON a.qname = b.qname AND a.side <> b.side JOIN n ON n.qname = a.qname WHERE NOT n.one)
  SELECT qname, flag, rname, pos, rnext, pnext, tags FROM y""",
    "blocks_to_cigar": "SELECT line_no, string_agg(coalesce(CAST(s - before AS VARCHAR) || 'N', '') || CAST(e - s AS VARCHAR) || 'M', '' ORDER BY s) AS cigar FROM (SELECT *, lag(e) OVER (PARTITION BY line_no ORDER BY s) AS before FROM blk) GROUP BY line_no",
    "sam_lines": """WITH c AS (SELECT line_no, string_agg(coalesce(CAST(s - before AS VARCHAR) || 'N', '') || CAST(e - s AS VARCHAR) || 'M', '' ORDER BY s) AS cigar FROM (SELECT *, lag(e) OVER (PARTITION BY line_no ORDER BY s) AS before FROM blk) GROUP BY line_no),
  x AS (SELECT frag, f.chrom, f.strand, f.nh, line_b IS NOT NULL AS paired, a.s AS sa, b.s AS sb, greatest(a.e, b.e) - a.s AS t, ca.cigar AS ca, cb.cigar AS cb
    FROM frags f JOIN span a ON a.line_no = line_a JOIN c ca ON ca.line_no = line_a LEFT JOIN span b ON b.line_no = line_b LEFT JOIN c cb ON cb.line_no = line_b)
  SELECT frag, 'a' AS side, concat_ws(chr(9), chrom || ':' || frag, CASE WHEN paired THEN '81' ELSE '0' END, chrom, sa, '50', ca, CASE WHEN paired THEN '=' ELSE '*' END, coalesce(sb, 0), CASE WHEN paired THEN t ELSE 0 END, '*', '*', 'NH:i:' || nh, 'XS:A:' || strand) AS line FROM x
  UNION ALL SELECT frag, 'b', concat_ws(chr(9), chrom || ':' || frag, '161', chrom, sb, '50', cb, '=', sa, -t, '*', '*', 'NH:i:' || nh, 'XS:A:' || strand) FROM x WHERE paired""",
    "force_xs": """SELECT frag, coalesce(f.strand, CASE WHEN a.n > 1 OR b.n > 1 THEN CASE WHEN frag % 2 = 0 THEN '+' ELSE '-' END END, '') AS strand FROM frags f JOIN span a ON a.line_no = line_a LEFT JOIN span b ON b.line_no = line_b""",
    "transcript_score_reciprocal": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY a, b, i ORDER BY greatest(x, 0) DESC, j) AS ri, row_number() OVER (PARTITION BY a, b, j ORDER BY greatest(x, 0) DESC, i) AS rj FROM tp)
  SELECT a, b, round(coalesce(sum(greatest(x, 0)) FILTER (WHERE ri = 1 AND rj = 1), 0) / (max(na) + max(nb) - count(*) FILTER (WHERE ri = 1 AND rj = 1)), 6) AS score FROM r GROUP BY a, b""",
    "transcript_score_product": """SELECT a, b, round(CASE WHEN max(na) = max(nb) THEN coalesce(max(x) FILTER (WHERE i = 0 AND j = 0), 1) * coalesce(max(x) FILTER (WHERE i = 1 AND j = 1), 1) ELSE 0 END, 6) AS score FROM tp GROUP BY a, b""",
    "transcript_score_overlap": "SELECT a, b, round(sum(greatest(0, least(e1, e2) - greatest(s1, s2))) ** 2 / (max(la) * max(lb))::DOUBLE, 6) AS score FROM tp GROUP BY a, b",
    "quant_outer_join": "SELECT transcript_id, round(x, 6) AS x, round(y, 6) AS y FROM quant",
    "quant_rmse": "SELECT round(sqrt(avg((x - y) ** 2)), 6) AS rmse, round(corr(x, y), 6) AS corr FROM quant",
}


def oracle_sql() -> dict[str, str]:
    """Each query's SQL with the steps of the prelude up to the last that it needs."""
    out = {}
    for name, final in FINAL.items():
        final = FINAL[final[1:]] if final.startswith("@") else final
        own = final[len("WITH ") :] if final.startswith("WITH ") else None
        heads = ",\n".join(f"{n} AS MATERIALIZED ({q})" if n in ("rows_", "blk", "sub", "inc", "rpath", "pairs", "frags", "loc", "el") else f"{n} AS ({q})" for n, q in _needed(final))
        out[name] = f"WITH {heads}{', ' + own if own and heads else ''}{own if own and not heads else ''}{'' if own else chr(10) + final}" if heads or own else final
    return out


def _needed(final: str) -> list[tuple[str, str]]:
    """The prelude's steps that a text refers to, directly or through others, in order."""
    import re

    names, open_ = set(), [final]
    steps = dict(PRELUDE)
    while open_:
        text = open_.pop()
        for word in set(re.findall(r"\w+", text)):
            if word in steps and word not in names:
                names.add(word)
                open_.append(steps[word])
    return [(n, q) for n, q in PRELUDE if n in names]
