"""SQL for ordered folds over the parts of a text, as the queries' twins say them."""

from __future__ import annotations


def trim(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def key(x: str) -> str:
    return trim(rf"regexp_replace(regexp_replace(lower({x}), '\s+', ' ', 'g'), '[^\p{{L}}\p{{N}}\s]', '', 'g')")


def parts(texts: str) -> str:
    """The trimmed texts of a list that are not empty."""
    return f"list_filter(list_transform({texts}, lambda x: {trim('x')}), lambda x: x <> '')"


def at_blank_lines(text: str) -> str:
    return rf"regexp_split_to_array({text}, '\n\s*\n')"


def at_ends(text: str, ends: str) -> str:
    """Sentences: split at white space behind one of `ends`."""
    return rf"string_split(regexp_replace({text}, '([{ends}])\s+', '\1' || chr(1), 'g'), chr(1))"


def _kept(texts: str, same: str) -> str:
    step = f"CASE WHEN x[1].k = '' OR len(list_filter(a, lambda o: {same})) > 0 THEN a ELSE list_concat(a, x) END"
    found = f"list_reduce(list_transform({texts}, lambda x: [struct_pack(k := {key('x')}, p := x)]), lambda a, x: {step}, []::STRUCT(k VARCHAR, p VARCHAR)[])"
    return f"list_transform({found}, lambda x: x.p)"


def distinct(texts: str) -> str:
    """The first text of each key."""
    return _kept(texts, "o.k = x[1].k")


def uncontained(texts: str) -> str:
    """The texts whose key neither holds nor is held by the key of one before."""
    return _kept(texts, "contains(o.k, x[1].k) OR contains(x[1].k, o.k)")


def packed(pieces: str, most: int, gap: int = 0) -> str:
    """
    Lists of pieces in order; a single piece joins what stands last, by a space, while both have at most `most` characters
    in all, the space counting `gap`.
    """
    step = f"CASE WHEN len(a) > 0 AND len(x) = 1 AND length(a[-1]) + {gap} + length(x[1]) <= {most} THEN list_concat(a[:-2], [a[-1] || ' ' || x[1]]) ELSE list_concat(a, x) END"
    return f"list_reduce({pieces}, lambda a, x: {step}, []::VARCHAR[])"


def cut(text: str, most: int) -> str:
    return f"list_transform(range(0, ceil(length({text}) / {most}.0)::INT), lambda i: {text}[i * {most} + 1 : i * {most} + {most}])"


def digest(texts: str) -> str:
    return f"len({texts})::BIGINT AS n, sha256(array_to_string({texts}, chr(10))) AS text_sha256"
