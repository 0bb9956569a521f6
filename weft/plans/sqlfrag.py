"""DuckDB SQL fragments shared by the oracles (mirrors of weft.functions.text)."""

# JavaScript \s, as an RE2 class
JS_SPACE = r"[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def js_trim(x: str) -> str:
    return f"regexp_replace({x}, '^{JS_SPACE}+|{JS_SPACE}+$', '', 'g')"


def not_blank(x: str) -> str:
    return f"({x} IS NOT NULL AND length({js_trim(x)}) > 0)"


def split_paragraphs(x: str) -> str:
    return (f"list_filter(list_transform(string_split_regex(replace({x}, chr(13) || chr(10), chr(10)), '\\n{{2,}}'),"
            f" lambda p: {js_trim('p')}), lambda p: length(p) > 0)")


def chunk_text(x: str, n: int = 4000) -> str:
    return (f"CASE WHEN length({x}) <= {n} THEN [{x}] ELSE "
            f"list_transform(range(0, length({x}), {n}), lambda s: substr({x}, s + 1, {n})) END")


def char_ids(x: str) -> str:
    return f"list_transform(string_split({x}, ''), lambda c: CASE WHEN unicode(c) < 256 THEN unicode(c) ELSE 63 END)"


def pieces_cte(max_chars: int = 4000) -> str:
    """documents -> non-blank -> paragraphs -> chunks (source, doc_id, para_idx, chunk_idx, piece)."""
    return f"""
docs AS (SELECT doc_id, source, text FROM documents WHERE {not_blank('text')}),
paras AS (SELECT doc_id, source, unnest(l) AS para, unnest(range(len(l))) AS para_idx
          FROM (SELECT doc_id, source, {split_paragraphs('text')} AS l FROM docs)),
pieces AS (SELECT doc_id, source, para_idx, unnest(c) AS piece, unnest(range(len(c))) AS chunk_idx
           FROM (SELECT *, {chunk_text('para', max_chars)} AS c FROM paras))"""


def stream_cte(eos: int = 256) -> str:
    """pieces -> char ids + eos -> start offsets (source, doc_id, para_idx, chunk_idx, ids, n_tokens, start)."""
    return f"""
enc AS (SELECT *, list_concat({char_ids('piece')}, [{eos}]) AS ids FROM pieces),
stream AS (SELECT *, len(ids) AS n_tokens,
           COALESCE(SUM(len(ids)) OVER (PARTITION BY source ORDER BY doc_id, para_idx, chunk_idx
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM enc),
toks AS (SELECT source, start + i AS pos, tok FROM
         (SELECT source, start, unnest(ids) AS tok, unnest(range(len(ids))) AS i FROM stream))"""
