"""DuckDB SQL for queries whose results SQL can express and that isn't beside its operator."""

from __future__ import annotations

from bagflow.llm.quality import DUPLICATE_SHARE, FEW, LINE_CHAR_SHARE, LINE_SHARE, ONCE_LINE_SHARE, ONCE_SHARE, SHORT, SYMBOL_SHARE


def crc_table() -> list[int]:
    """The reflected CRC-32 of each byte, by its polynomial."""
    out = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ (0xEDB88320 if byte & 1 else 0)
        out.append(byte)
    return out


#: A row per document; the checksum goes over the bytes of the text in hexadecimal.
SHARDS = f"""
with d as (select doc_id, cast(strlen(coalesce(text, '')) + 1 as bigint) as size, lower(hex(encode(coalesce(text, '')))) as h from documents),
c as (select doc_id, size, cast(xor(list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(range(0, size - 1), lambda i:
    cast(16 * (strpos('0123456789abcdef', substr(h, 2 * i + 1, 1)) - 1) + strpos('0123456789abcdef', substr(h, 2 * i + 2, 1)) - 1 as bigint))),
    lambda a, b: xor(a >> 8, ({crc_table()}::bigint[])[1 + (xor(a, b) & 255)])), cast(4294967295 as bigint)) as bigint) as text_crc32 from d),
p as (select *, sum(size) over (order by doc_id, text_crc32, size rows unbounded preceding) as upto, sum(size) over () as total from c),
s as (select *, cast(((2 * upto - size) * 8) // (2 * total) as int) as shard from p)
select doc_id, size, text_crc32, 'bytes' as law, shard, row_number() over (partition by shard order by upto) - 1 as slot, cast(null as int) as grown_shard from s
"""

QUALITY = rf"""
with w as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
g as (select doc_id, n, i, array_to_string(list_slice(ws, i, i + n - 1), ' ') as g from (
    select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) as i from w, (select unnest([3, {", ".join(map(str, DUPLICATE_SHARE))}]) as n) t)),
r as (select doc_id, n, i from (select *, count(*) over (partition by doc_id, n, g) as times from g) where times > 1),
v as (select distinct doc_id, n, i + k as p from r, range(0, 10) t(k) where k < n),
a as (select v.doc_id, n, count(*) as hit, sum(length(ws[p])) as chars from v join w on v.doc_id = w.doc_id group by 1, 2),
l as (select doc_id, line, row_number() over (partition by doc_id, line) > 1 as again from (select doc_id, unnest(string_split(text, chr(10))) as line from w)
    where regexp_matches(line, '[^\x20\x09-\x0D]')),
k as (select doc_id, count(*) as n_lines, count(*) filter (where again) as dup_lines, sum(length(line)) as chars, coalesce(sum(length(line)) filter (where again), 0) as dup_chars from l group by 1),
b as (select w.doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) as bigint) as word_chars,
    cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols, coalesce(dup_lines, 0) as n_dup_lines,
    coalesce((select hit from a where a.doc_id = w.doc_id and n = 3), 0) as n_repeat_words,
    coalesce(len(ws) < {SHORT} and dup_lines between 1 and {FEW}, false) as few,
    coalesce(dup_lines <= (case when len(ws) < {SHORT} and dup_lines between 1 and {FEW} then {ONCE_LINE_SHARE} else {LINE_SHARE} end) * n_lines
        and dup_chars <= {LINE_CHAR_SHARE} * chars, true) as lines_good from w left join k on w.doc_id = k.doc_id),
o as (select distinct a.doc_id from a join b on a.doc_id = b.doc_id
    where {" or ".join(f"n = {n} and chars > (case when few then {ONCE_SHARE[n]} else {most} end) * word_chars" for n, most in DUPLICATE_SHARE.items())}),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from b)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    not base_failed and lines_good and n_symbols <= {SYMBOL_SHARE} * n_words and doc_id not in (select doc_id from o) as kept from f
"""
