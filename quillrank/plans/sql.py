"""Pieces of the oracle's SQL that several queries share."""

from __future__ import annotations

from quillrank import config

_STOP = "[" + ", ".join(f"'{w}'" for w in config.STOP_WORDS) + "]"


def words_sql(text: str, stop: bool = True) -> str:
    cut = f"string_split(trim(regexp_replace(lower({text}), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')), ' ')"
    return f"list_filter({cut}, lambda w: length(w) > 1{f' AND NOT list_contains({_STOP}, w)' if stop else ''})"


def grams_sql(words: str, n: int) -> str:
    """All 1- to n-grams of a list of words."""
    each = [f"list_transform(range(1, len({words}) - {k - 2}), lambda i: " + " || ' ' || ".join(f"{words}[i + {j}]" for j in range(k)) + ")" for k in range(2, n + 1)]
    return f"list_concat({words}, {', '.join(each)})" if each else words


def skills_sql(text: str, vocabulary: list[str]) -> str:
    """The sorted skills of a text: words by word, phrases wherever they are in the normalised text."""
    low = f"lower({text})"
    for old, new in config.SKILL_ALIASES.items():
        low = f"replace({low}, '{old}', '{new}')"
    norm = f"trim(regexp_replace({low}, '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))"
    of = lambda phrases: "[" + ", ".join(f"'{v}'" for v in vocabulary if (" " in v) == phrases) + "]::varchar[]"
    return f"list_sort(list_distinct(list_concat(list_intersect(string_split({norm}, ' '), {of(False)}), list_filter({of(True)}, lambda p: contains({norm}, p)))))"


def tfidf_sql(n: int, tf: str, where: str = "true") -> str:
    """CTEs up to s (item_id, doc_id, tfidf): 1- to n-grams of documents against those of each benchmark text, by pairs that
    share one."""
    w = tf.format
    return f"""w AS (SELECT doc_id, {words_sql("text")} AS ws FROM documents), t AS (SELECT doc_id, unnest({grams_sql("ws", n)}) AS term FROM w), tf AS (SELECT doc_id, term, count(*) AS n FROM t GROUP BY ALL),
  m AS (SELECT count(DISTINCT doc_id) AS docs FROM tf), idf AS (SELECT term, ln((1 + (SELECT docs FROM m)) / (1 + count(*))::double) + 1 AS idf FROM tf GROUP BY 1),
  jw AS (SELECT item_id, {words_sql("text")} AS ws FROM benchmark WHERE {where}), jt AS (SELECT item_id, unnest({grams_sql("ws", n)}) AS term FROM jw),
  q AS (SELECT item_id, term, {w(n="count(*)")} * any_value(idf) AS q FROM jt JOIN idf USING (term) GROUP BY 1, 2), qn AS (SELECT item_id, sqrt(sum(q * q)) AS qn FROM q GROUP BY 1),
  dn AS (SELECT doc_id, sqrt(sum(({w(n="n")} * idf) ** 2)) AS dn FROM tf JOIN idf USING (term) GROUP BY 1),
  s AS (SELECT item_id, doc_id, sum({w(n="n")} * idf * q) / (any_value(dn) * any_value(qn)) AS tfidf FROM tf JOIN idf USING (term) JOIN q USING (term) JOIN dn USING (doc_id) JOIN qn USING (item_id) GROUP BY 1, 2)"""
