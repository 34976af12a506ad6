"""Oracle SQL of the training-data queries that plain SQL can express."""

from . import license_scan
from .license_scan import COVERED, GRAM, NEIGHBOURS, STRETCH

SHARDS = 24
_SCORE = "-ln((('0x' || substr(md5(coalesce('k' || doc_id, 'n') || ':' || s), 1, 13))::BIGINT + 0.5) / 4503599627370496)"

#: The table of CRC-32 comes from its rule; rendezvous scores and the order of slots from digests.
RENDEZVOUS = f"""WITH RECURSIVE steps AS (
    SELECT i, 0 AS step, i::BIGINT AS v FROM range(256) x(i)
    UNION ALL SELECT i, step + 1, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM steps WHERE step < 8),
  crc AS (SELECT list(v ORDER BY i) AS l FROM steps WHERE step = 8),
  texts AS (SELECT DISTINCT coalesce(text, '') AS t FROM documents),
  bytes AS (SELECT t, hex(encode(t)) AS h FROM texts),
  sums AS (SELECT t, xor(4294967295, list_reduce(
      list_prepend(4294967295::BIGINT, [('0x' || h[2 * i + 1:2 * i + 2])::BIGINT FOR i IN range(len(h) // 2)]),
      lambda a, b: xor(a >> 8, l[(xor(a, b) & 255) + 1]))) AS text_crc32 FROM bytes, crc),
  rows AS (SELECT doc_id, (strlen(t) + 8)::BIGINT AS size, text_crc32 FROM documents JOIN sums ON coalesce(text, '') = t),
  ids AS (SELECT DISTINCT doc_id FROM rows),
  scores AS (SELECT doc_id, s, {_SCORE} AS score FROM ids, range({SHARDS + 1}) y(s)),
  homes AS (SELECT doc_id, arg_min(s, score) FILTER (s < {SHARDS})::INT AS shard, arg_min(s, score)::INT AS grown_shard FROM scores GROUP BY doc_id)
  SELECT r.doc_id, size, text_crc32, 'key' AS law, shard,
    row_number() OVER (PARTITION BY shard ORDER BY md5(concat_ws('|', coalesce('k' || r.doc_id, 'n'), 'k' || size, 'k' || text_crc32)),
                       r.doc_id, size, text_crc32) - 1 AS slot, grown_shard
  FROM rows r JOIN homes h ON r.doc_id IS NOT DISTINCT FROM h.doc_id"""

WARC = """WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
  g AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
  SELECT page_id, strlen(payload)::BIGINT AS payload_bytes,
    array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      ((('0x' || substr(p.h, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1) FOR i IN range(32)], '') AS payload_digest,
    CASE WHEN page_id IS NOT DISTINCT FROM first OR first IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id IS NOT DISTINCT FROM first THEN NULL ELSE first END AS refers_to
  FROM p JOIN g ON p.h = g.h"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
  b AS (SELECT row_number() OVER () AS item, item_id, {_WORDS} AS w FROM benchmark),
  windows AS (SELECT item, item_id, j, least(10, len(w)) AS n, array_to_string(w[j:j + least(10, len(w)) - 1], ' ') AS s
              FROM (SELECT item, item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS j FROM b WHERE len(w) > 0)),
  sizes AS (SELECT DISTINCT n FROM windows),
  places AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
             FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
  hits AS (SELECT doc_id, item, item_id, i, j, p.n FROM places p JOIN windows v ON p.n = v.n AND p.s = v.s),
  runs AS (SELECT DISTINCT doc_id, i, n FROM hits),
  lanes AS (SELECT doc_id, item, i - j AS lane, n, i - row_number() OVER (PARTITION BY doc_id, item, i - j ORDER BY i) AS island FROM hits),
  longest AS (SELECT doc_id, max(m) AS longest_match FROM (SELECT doc_id, count(*) + n - 1 AS m FROM lanes GROUP BY doc_id, item, lane, n, island) GROUP BY doc_id),
  covered AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM runs) GROUP BY doc_id),
  items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS l
            FROM (SELECT DISTINCT doc_id, item_id FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id)
  SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
    coalesce(longest_match, 0)::BIGINT AS longest_match
  FROM d LEFT JOIN covered c ON d.doc_id = c.doc_id LEFT JOIN items i ON d.doc_id = i.doc_id LEFT JOIN longest g ON d.doc_id = g.doc_id"""

_SPLIT = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

PHRASES = f"""WITH d AS (SELECT doc_id, {_SPLIT} AS w FROM documents),
  windows AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h
              FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
  firsts AS (SELECT h, min(doc_id) AS first FROM windows GROUP BY h),
  gone AS (SELECT doc_id, list(DISTINCT j) AS l FROM (
      SELECT doc_id, unnest(range(i, i + 50)) AS j FROM windows JOIN firsts USING (h) WHERE first < doc_id) GROUP BY doc_id),
  kept AS (SELECT d.doc_id, w, l, CASE WHEN l IS NULL THEN w ELSE
      list_transform(list_filter(list_zip(w, range(1, len(w) + 1), [m IS NOT NULL FOR m IN list_transform(range(1, len(w) + 1),
        lambda x: CASE WHEN list_contains(l, x) THEN 1 END)]), lambda z: NOT z[3]), lambda z: z[1]) END AS k
    FROM d LEFT JOIN gone ON d.doc_id = gone.doc_id)
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(l), 0)::BIGINT AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept"""

_SPACELESS = r"regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')"
_SCORES = ["n_symbols / greatest(word_chars, 1)", "n_dup_lines / greatest(n_lines, 1)", "n_repeat_words / greatest(n_words, 1)",
           "n_upper / greatest(word_chars, 1)", "n_loud / greatest(n_words, 1)"]
#: Risk 0.02 shared by five rules; 1 - 0.95 confidence shared by rules and strata.
_P = 0.02 / 5

QUALITY = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t FROM documents),
  w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM d),
  places AS (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
  twice AS (SELECT r, s FROM places GROUP BY r, s HAVING count(*) > 1),
  covered AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS j FROM places JOIN twice USING (r, s)) GROUP BY r),
  m AS (SELECT d.r, doc_id, stratum, t, len(w)::BIGINT AS n_words, length({_SPACELESS})::BIGINT AS word_chars,
        (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
        coalesce(covered.n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines,
        length({_SPACELESS}) - length(regexp_replace({_SPACELESS}, '\p{{Lu}}+', '', 'g')) AS n_upper, length(t) - length(replace(t, '!', '')) AS n_loud
        FROM d JOIN w ON d.r = w.r LEFT JOIN covered ON d.r = covered.r),
  f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
        [{", ".join(f"least(floor(100 * {s}), 100)::INT" for s in _SCORES)}] AS bins FROM m),
  known AS (SELECT stratum, any_value(bins) AS bins, bool_or(quality > 0) AS good FROM f JOIN labels USING (doc_id) WHERE quality IS NOT NULL
            GROUP BY stratum, t HAVING bool_or(quality > 0) = bool_and(quality > 0)),
  bars AS (SELECT stratum, rule, bins[rule] AS bin, count(*) FILTER (good) AS good, count(*) FILTER (NOT good) AS bad
           FROM known, range(1, 6) x(rule) GROUP BY ALL),
  sums AS (SELECT stratum, rule, bin, sum(good) OVER whole AS n, sum(good) OVER down AS k, sum(bad) OVER down AS caught FROM bars
           WINDOW whole AS (PARTITION BY stratum, rule), down AS (PARTITION BY stratum, rule ORDER BY bin DESC)),
  tails AS (SELECT *, CASE WHEN bin > 0 AND k <= {_P} * n THEN list_sum([exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1)
              + i * ln({_P}) + (n - i) * ln(1 - {_P})) FOR i IN range(0, k::BIGINT + 1)]) ELSE 1 END AS tail FROM sums),
  safe AS (SELECT *, min(CASE WHEN tail <= 0.05 / (5 * greatest(1, (SELECT count(DISTINCT stratum) FROM known WHERE good))) THEN 1 ELSE 0 END)
             OVER (PARTITION BY stratum, rule ORDER BY bin DESC) AS ok FROM tails),
  cuts AS (SELECT stratum, rule, arg_max(bin, caught * 1000 + bin) AS cut FROM safe WHERE ok = 1 AND caught > 0 GROUP BY ALL),
  fails AS (SELECT DISTINCT r FROM f JOIN cuts USING (stratum) WHERE bins[rule] >= cut)
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
         NOT base_failed AND r NOT IN (SELECT r FROM fails) AS kept FROM f"""

_TEMPLATES = ", ".join(f"({i}, '{label}', {exact}, '{text}')" for i, (label, text, exact) in enumerate(
    [(*p, True) for p in license_scan.PHRASES] + [(*n, False) for n in license_scan.NOTICES]))

LICENSES = f"""WITH t AS (SELECT template, label, exact, {_WORDS} AS w FROM (VALUES {_TEMPLATES}) x(template, label, exact, text)),
  tg AS (SELECT template, label, exact, len(w) AS n, j AS tpos, array_to_string(w[j + 1:j + {GRAM}], ' ') AS gram
         FROM (SELECT *, unnest(range(0, len(w) - {GRAM - 1})) AS j FROM t)),
  d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
  g AS (SELECT r, i AS pos, array_to_string(w[i + 1:i + {GRAM}], ' ') AS gram FROM (SELECT r, w, unnest(range(0, len(w) - {GRAM - 1})) AS i FROM d)),
  h AS (SELECT DISTINCT r, template, label, exact, n, pos - tpos AS diagonal, tpos FROM g JOIN tg USING (gram)),
  base AS (SELECT r, label, diagonal AS first FROM h WHERE exact GROUP BY r, template, label, n, diagonal HAVING count(*) = n - {GRAM - 1}),
  steps AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER down <= {NEIGHBOURS} THEN 0 ELSE 1 END AS new
            FROM (SELECT DISTINCT r, template, diagonal FROM h WHERE NOT exact) WINDOW down AS (PARTITION BY r, template ORDER BY diagonal)),
  copies AS (SELECT r, template, diagonal, sum(new) OVER (PARTITION BY r, template ORDER BY diagonal) AS copy FROM steps),
  found AS (SELECT r, label, n, count(DISTINCT tpos + k) / n AS score, max(diagonal + tpos) + {GRAM} - min(diagonal + tpos) AS stretch
            FROM h JOIN copies USING (r, template, diagonal), range({GRAM}) z(k) GROUP BY r, template, label, n, copy),
  labelled AS (SELECT r, label, 1.0::DOUBLE AS score, true AS verified FROM base
               UNION ALL SELECT r, label, score, score >= {COVERED} AND stretch <= n * {STRETCH} FROM found),
  bases AS (SELECT r, count(*) AS n_base, min(first) AS first_word, max(first) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS l FROM base GROUP BY r),
  alls AS (SELECT r, max(score) AS score, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (verified) AS l FROM labelled GROUP BY r)
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
    coalesce(b.l, '') AS base_labels, coalesce(a.l, '') AS labels, coalesce(score, 0)::DOUBLE AS score
  FROM d LEFT JOIN bases b ON d.r = b.r LEFT JOIN alls a ON d.r = a.r"""

HARD_NEGATIVES = """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
      [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT a.vec_id AS anchor_id, e.vec_id, a.label = e.label AS same,
      list_sum([a.v[i] * e.v[i] FOR i IN range(1, len(a.v) + 1)])::BIGINT AS score
    FROM e a JOIN e ON a.vec_id % 100 = 0 AND a.vec_id <> e.vec_id),
  p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
  SELECT anchor_id, positive_id, row_number() OVER best::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
  WINDOW best AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER best <= 10"""

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

LEXICAL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
  b AS (SELECT DISTINCT item, item_id, unnest(w) AS t FROM (SELECT row_number() OVER () AS item, item_id, {_TERMS} AS w FROM benchmark)),
  size AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0),
  p AS (SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM b) GROUP BY ALL),
  f AS (SELECT t, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT AS weight FROM (SELECT t, count(*) AS df FROM p GROUP BY t), size),
  s AS (SELECT item, item_id, r, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score
        FROM b JOIN f USING (t) JOIN p USING (t), size GROUP BY item, item_id, r, doc_id)
  SELECT item_id, row_number() OVER best::INT AS rank, doc_id, score FROM s WHERE score > 0
  WINDOW best AS (PARTITION BY item ORDER BY score DESC, doc_id) QUALIFY row_number() OVER best <= 50"""
