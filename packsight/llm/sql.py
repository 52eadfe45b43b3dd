"""DuckDB SQL for the operator queries that SQL can express."""

_BOILERPLATE = (
    "all rights reserved",
    "accept cookies",
    "click here",
    "cookie policy",
    "enable javascript",
    "lorem ipsum",
    "privacy policy",
    "read more",
    "share this",
    "sign in",
    "subscribe to our",
    "terms of use",
)
_PHRASES = " or ".join(f"contains(lower(line), '{p}')" for p in _BOILERPLATE)

OP9 = rf"""
with d as (select doc_id, coalesce(text, '') as text from documents),
w as (select doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words from d),
lines as (select doc_id, line, k from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as k from d)
          where regexp_matches(line, '[^\x20\x09-\x0D]')),
solid as (select doc_id, line, count(*) - 1 as again, length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) as chars,
            length(line) - length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) as spaces,
            length(line) - length(regexp_replace(line, '[#*$%&|<>!?]', '', 'g')) as marks,
            length(line) - length(regexp_replace(line, '[|»›·•]', '', 'g')) as separators
          from lines group by doc_id, line),
line_sums as (select doc_id, sum(again) as n_dup_lines, coalesce(sum(chars) filter (not (
            100 * marks > 20 * chars or (separators >= 3 and 3 * separators >= spaces)
            or (upper(line) = line and lower(line) <> line and spaces >= 4) or {_PHRASES})), 0) as good
          from solid group by doc_id),
win as (select doc_id, i, words[i:i + 4] as five from (select doc_id, words, unnest(range(1, len(words) - 3)) as i from w where len(words) >= 5)),
rep as (select doc_id, i from win qualify count(*) over (partition by doc_id, five) > 1),
cover as (select doc_id, sum(least(5, coalesce(following - i, 5))) as n from (select doc_id, i, lead(i) over (partition by doc_id order by i) as following from rep) group by doc_id),
counted as (select w.doc_id, len(words)::bigint as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
            (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
            coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(cover.n, 0)::bigint as n_repeat_words, coalesce(good, 0) as good
          from w left join line_sums using (doc_id) left join cover using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 10 or 100 * n_repeat_words > 20 * n_words) as base_failed,
  (not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and 100 * (word_chars - good) <= 30 * word_chars) as kept
from counted
"""

ORACLE_SQL = {"op9_rules": OP9}
