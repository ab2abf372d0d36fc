"""SQL of the oracle's dialect for the operators whose results it can express, written from their definitions.

Tokenizers, the language model, drawn numbers and crc32 have none.
"""

from __future__ import annotations

from quillrank.llm import quality, secrets

_WORD = r"[^\x20\x09-\x0D]+"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def near_duplicates(n: int, percent: int) -> str:
    """All pairs of documents that share a shingle, their links by full sets, and the least doc_id reachable."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    gram = " || ' ' || ".join(f"w[i + {k}]" for k in range(n))
    return f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '{_WORD}') AS w FROM documents),
  g AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {n} THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - {n - 2}), lambda i: {gram})) END) AS s FROM d),
  n AS (SELECT d.doc_id, count(s) AS n_shingles FROM d LEFT JOIN g USING (doc_id) GROUP BY 1),
  p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g AS a JOIN g AS b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
  l AS (SELECT a, b FROM p JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * c >= {percent} * (x.n_shingles + y.n_shingles - c)),
  e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
  r AS (SELECT doc_id, doc_id AS upto FROM n UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.upto),
  c AS (SELECT doc_id, min(upto) AS component_id FROM r GROUP BY 1)
  SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN c USING (doc_id)"""


def embedding_duplicates(least: float) -> str:
    """Every pair of one label by cosine, and the least vec_id reachable by links."""
    return f"""WITH RECURSIVE v AS (SELECT vec_id, label, embedding::double[] AS x FROM embeddings),
  u AS (SELECT vec_id, label, x, sqrt(list_dot_product(x, x)) AS norm FROM v WHERE label IS NOT NULL AND len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(x, lambda y: y <> 0)) > 0),
  l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u AS a JOIN u AS b ON a.label = b.label AND len(a.x) = len(b.x) AND a.vec_id < b.vec_id WHERE list_dot_product(a.x, b.x) / (a.norm * b.norm) >= {least}),
  e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
  n AS (SELECT a AS vec_id, count(*) AS n_links FROM e GROUP BY 1),
  r AS (SELECT vec_id, vec_id AS upto FROM v UNION SELECT r.vec_id, e.b FROM r JOIN e ON e.a = r.upto),
  c AS (SELECT vec_id, min(upto) AS component_id FROM r GROUP BY 1)
  SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)"""


def _either_case(pattern: str) -> str:
    """Letters outside classes as classes of both cases."""
    out, inside = "", False
    for i, ch in enumerate(pattern):
        inside = ch == "[" or (inside and ch != "]")
        escaped = i > 0 and "\\" in pattern[max(0, i - 3) : i]
        out += f"[{ch.upper()}{ch}]" if ch.isalpha() and not inside and not escaped else ch
    return out


def secret_scan() -> str:
    """Each rule's matches with their places, from the lengths of matches and of the pieces between them."""
    parts = []
    for i, r in enumerate(secrets.BASE + secrets.MORE):
        pattern = _quoted(_either_case(r.pattern) if r.fold else r.pattern)
        if r.kind == "hex":
            # runs of one class: those that are long enough are the same whether short ones are matched or not
            pattern = _quoted(f"[0-9a-f]{{{r.least},}}")
        parts.append(f"""SELECT doc_id, {i} AS rank, '{r.kind}' AS kind, unnest(list_transform(range(1, len(m) + 1), lambda i: {{'g': g[i], 'a': coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0), 'n': length(m[i])}})) AS s, {r.least} AS least
    FROM (SELECT doc_id, regexp_extract_all(t, {pattern}) AS m, regexp_extract_all(t, {pattern}, {r.group}) AS g, string_split_regex(t, {pattern}) AS p FROM d WHERE regexp_matches(t, {pattern}))""")
    base = ", ".join(_quoted(r.kind) for r in secrets.BASE)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({" UNION ALL ".join(parts)}),
  s AS (SELECT doc_id, kind, rank, s.a AS a, kind || ':' || s.a::bigint || ':' || (s.a + s.n)::bigint AS span FROM f WHERE length(s.g) >= least),
  o AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(span, ',' ORDER BY a, rank) FILTER (kind IN ({base})) AS base, string_agg(span, ',' ORDER BY a, rank) AS spans FROM s GROUP BY 1)
  SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN o USING (doc_id)"""


def quality_rules(fences: list[quality.Fence] = quality.FENCES, least_docs: int = 30) -> str:
    """The fields, each group's limits from its values' cells in order, and the verdict."""
    long = ", ".join(f"{{'f': '{x.feature}', 'v': {x.feature}}}" for x in fences)
    cell = "({0}) - ({0}) % (1::bigint << greatest(length(bin({0})) - 7, 0))".format
    at = lambda mille: f"v[(len(v) * {mille} + 999) // 1000]"
    cuts = ", ".join(f"max({at(m)}) FILTER (f = '{x.feature}') AS {x.feature}_{k}" for x in fences for k, m in (("low", 1000 - x.level), ("mid", 500), ("high", x.level)))
    fine = []
    for x in fences:
        n, own = f"t.{x.feature}", cell(f"m.{x.feature}")
        fine.append(f"{own} <= {n}_high + {x.reach} * ({n}_high - {n}_mid)")
        if x.low:
            fine.append(f"{own} >= {n}_low - {x.reach} * ({n}_mid - {n}_low)")
    return f"""WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS l FROM documents),
  g AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: {{'i': i, 'g': w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]}})) AS x FROM d),
  k AS (SELECT doc_id, x.i AS i, count(*) OVER (PARTITION BY doc_id, x.g) AS n FROM g),
  c AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM k WHERE n > 1) GROUP BY 1),
  b AS (SELECT doc_id, lang, source, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM d LEFT JOIN c USING (doc_id)),
  m AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, n_symbols * 1000 // greatest(n_words, 1) AS symbols, n_dup_lines * 1000 // greatest(n_lines, 1) AS dup_lines,
    n_repeat_words * 1000 // greatest(n_words, 1) AS repeats, word_chars * 100 // greatest(n_words, 1) AS word_length FROM b),
  o AS (SELECT lang, source, unnest([{long}]) AS x FROM m WHERE NOT base_failed),
  v AS (SELECT lang, source, x.f AS f, {cell('x.v')} AS cell FROM o),
  l0 AS (SELECT lang, source, f, list_sort(list(cell)) AS v0 FROM v GROUP BY ALL), l1 AS (SELECT lang, f, list_sort(list(cell)) AS v1 FROM v GROUP BY ALL), l2 AS (SELECT f, list_sort(list(cell)) AS v2 FROM v GROUP BY ALL),
  q AS (SELECT l0.lang, source, l0.f, CASE WHEN len(v0) >= {least_docs} THEN v0 WHEN len(v1) >= {least_docs} THEN v1 ELSE v2 END AS v FROM l0 JOIN l1 ON l1.lang IS NOT DISTINCT FROM l0.lang AND l1.f = l0.f JOIN l2 ON l2.f = l0.f),
  t AS (SELECT lang, source, {cuts} FROM q GROUP BY 1, 2)
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce({" AND ".join(fine)}, false) AS kept
  FROM m LEFT JOIN t ON t.lang IS NOT DISTINCT FROM m.lang AND t.source IS NOT DISTINCT FROM m.source"""


def chat() -> str:
    """Turns and trainable texts as they are, and the lengths of all examples from running sums of turns' lengths."""
    escaped = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '\"', '&quot;')".format
    order = "turn ASC NULLS LAST, role ASC NULLS FIRST, said ASC NULLS FIRST"
    said = r"\### Assistant: </turn> ok"
    return f"""WITH a AS (SELECT conv_id, turn, role, text AS said FROM conversations UNION ALL SELECT -7, 0, 'user', '{said}' UNION ALL SELECT -7, 1, 'assistant', '{said}'),
  t AS (SELECT conv_id, turn, role, said, coalesce(role, '') AS r, coalesce(said, '') AS x, coalesce(role = 'assistant', false) AS target FROM a),
  n AS (SELECT *, sum(length('<turn "' || {escaped("r")} || '">' || {escaped("x")} || '</turn>') + 1) OVER (PARTITION BY conv_id ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS upto, lead(1) OVER (PARTITION BY conv_id ORDER BY {order}) IS NULL AS is_last FROM t),
  c AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY {order})) AS turns_sha256, coalesce(string_agg(x, '' ORDER BY {order}) FILTER (target), '') AS loss,
    sum(upto) FILTER (target OR is_last)::bigint AS formatted_chars FROM n GROUP BY 1)
  SELECT conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM c"""


def exact_duplicates() -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{upper}', '{upper.lower()}') AS t FROM documents),
  g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
  SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)"""


def lexical_search(k: int = 10) -> str:
    """Every document's score for each item from whole-number impacts, and the first k of each item."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    terms = f"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""WITH d AS (SELECT doc_id, {terms} AS w FROM documents), s AS (SELECT count(*) FILTER (len(w) > 0) AS n_docs, sum(len(w))::bigint AS total FROM d),
  p AS (SELECT doc_id, term, count(*) AS tf, any_value(n) AS n FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY 1, 2),
  q AS (SELECT DISTINCT item_id, unnest({terms}) AS term FROM benchmark),
  f AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)::double))::bigint AS weight FROM p, s WHERE term IN (SELECT term FROM q) GROUP BY term, n_docs),
  r AS (SELECT item_id, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // total))))::bigint AS score FROM q JOIN f USING (term) JOIN p USING (term), s GROUP BY 1, 2),
  o AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM r WHERE score > 0)
  SELECT item_id, rank::int AS rank, doc_id, score FROM o WHERE rank <= {k}"""


ORACLE = {
    "op3_near_duplicates": near_duplicates(3, 85),
    "op4_secret_scan": secret_scan(),
    "op5_embedding_duplicates": embedding_duplicates(0.93),
    "op7_quality_rules": quality_rules(),
    "op8_chat": chat(),
    "op11_exact_dedup": exact_duplicates(),
    "op13_lexical_search": lexical_search(),
}
