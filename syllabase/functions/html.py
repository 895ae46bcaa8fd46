"""Stored pages as text, anchors and elements.

No HTML parser runs. ``with_elements`` pairs each tag with its own closing tag
by depth, so elements may be nested; ``inner`` and ``anchors`` take a tag up to
the first closing one, which is right for elements that can't hold their like.
All but ``with_elements`` are expressions on the JVM.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as X

# The character references that occur in ordinary text.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
UNSEEN = r"(?is)<(script|style|noscript|svg)\b[^>]*>.*?</\1>|<!--.*?-->"
ANCHOR = r"(?is)<a\s[^>]*?href\s*=\s*[\"']([^\"']*)[\"'][^>]*>(.*?)</a>"


def visible(html: Column) -> Column:
    """Page source without scripts, styles and comments."""
    return F.regexp_replace(X.text(html), UNSEEN, "")


def decode(col: Column) -> Column:
    return reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), ENTITIES, col)


def plain(fragment: Column) -> Column:
    """Text of a fragment on one line."""
    return X.norm(decode(F.regexp_replace(fragment, "<[^>]*>", " ")))


def lines(html: Column) -> Column:
    """Text lines of a visible page; every tag ends a line."""
    parts = F.split(decode(F.regexp_replace(html, "<[^>]*>", "\n")), "\n")
    return F.filter(F.transform(parts, X.norm), lambda s: s != "")


def inner(html: Column, tag: str) -> Column:
    """Inner source of every element of one tag."""
    return F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"), F.lit(1))


def paired(html: str, pattern: re.Pattern, kinds: int) -> list[dict]:
    """Elements of a page by kind, each kind in page order: the ``k``-th group of the pattern is filled where a tag is of kind ``k``."""
    found: list[list] = [[] for _ in range(kinds)]
    open_: list[list] = [[] for _ in range(kinds)]
    for m in pattern.finditer(html):
        kind = m.lastindex - 2
        if m[1]:
            if open_[kind]:
                open_[kind].pop()[3] = m.start()
        else:
            # tag, start of the body, next tag of the kind, closing tag
            found[kind].append([m[0], m.end(), None, None])
            open_[kind].append(found[kind][-1])
        last = found[kind][-1 if m[1] or len(found[kind]) < 2 else -2] if found[kind] else None
        if last is not None and last[2] is None and last[1] <= m.start():
            last[2] = m.start()
    return [{"kind": k, "tag": tag, "body": html[at:shut if shut is not None else next_]}
            for k, own in enumerate(found) for tag, at, next_, shut in own]


#: Bytes of a batch whose elements are made at a time.
PIECE = 4 << 20


def pieces(batches: Iterator[pa.RecordBatch], size: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about ``size`` bytes, one row at least, without a copy."""
    for batch in batches:
        step = max(1, batch.num_rows * size // max(1, batch.nbytes))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def with_elements(df: DataFrame, html: Column, tags: list[str], into: str) -> DataFrame:
    """``df`` with the elements of ``html``: an array of (kind, tag, body) by kind as listed, then in page order, nested ones too.

    ``kind`` is the number of the element's pattern in ``tags``, ``tag`` its opening tag, ``body`` the source up to the closing tag of
    the same depth, or, if it has none, up to the next tag of its kind. A closing tag without an opening one counts for nothing. One
    pass over each page with a stack per kind, in batches; sums and sorts of tag places by array functions took ten times as long.
    The elements of a batch, nested ones many times, are made and handed on in pieces, so Python's memory does not grow with the batch.
    """
    rows = df.withColumn(into, html)
    rx = r"<(/?)(?:" + "|".join(f"({t})" for t in tags) + r")(?:\s[^>]*)?/?>"
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("tag", pa.string()), ("body", pa.string())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile(rx, re.I | re.S | re.A)
        for batch in pieces(batches):
            at = batch.schema.get_field_index(into)
            made = pa.array([None if t is None else paired(t, pattern, len(tags)) for t in batch.column(at).to_pylist()], kind)
            columns = [made if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    element = T.ArrayType(T._parse_datatype_string("struct<kind:int,tag:string,body:string>"))
    fields = [T.StructField(into, element) if f.name == into else f for f in rows.schema.fields]
    return rows.mapInArrow(scan, T.StructType(fields))


def anchors(html: Column) -> Column:
    """Array of (href, text) in page order."""
    found = F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(0))
    return F.transform(
        found,
        lambda a: F.struct(
            F.trim(decode(F.regexp_extract(a, ANCHOR, 1))).alias("href"), plain(F.regexp_extract(a, ANCHOR, 2)).alias("text")
        ),
    )


def _no_dots(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments of an absolute path."""
    segments = F.split(path, "/")
    parts = F.slice(segments, F.lit(2), F.size(segments))
    folder = path.rlike(r"(^|/)\.{1,2}$")
    stack = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(s == ".", acc)
        .otherwise(F.array_append(acc, s)),
    )
    tidy = F.concat(F.lit("/"), F.array_join(stack, "/"), F.when(folder & (F.size(stack) > 0), "/").otherwise(""))
    return F.when(path.rlike(r"(^|/)\.{1,2}(/|$)"), tidy).otherwise(path)


def resolve_url(base: Column, href: Column) -> Column:
    """Absolute address of a link without its fragment."""
    h = F.regexp_replace(href, "#.*$", "")
    page = F.regexp_replace(base, "#.*$", "")
    origin = F.regexp_extract(page, r"^([A-Za-z][\w+.\-]*://[^/?#]+)", 1)
    scheme = F.regexp_extract(page, r"^([A-Za-z][\w+.\-]*:)", 1)
    path = F.regexp_extract(page, r"^[A-Za-z][\w+.\-]*://[^/?#]+([^?#]*)", 1)
    folder = F.regexp_replace(F.when(path == "", "/").otherwise(path), r"[^/]*$", "")
    query = F.regexp_extract(h, r"(\?.*)$", 1)
    target = F.regexp_replace(h, r"\?.*$", "")
    return (
        F.when(h.rlike(r"^[A-Za-z][\w+.\-]*:"), h)
        .when(h.startswith("//"), F.concat(scheme, h))
        .when(h == "", page)
        .when(h.startswith("?"), F.concat(origin, path, h))
        .when(h.startswith("/"), F.concat(origin, _no_dots(target), query))
        .otherwise(F.concat(origin, _no_dots(F.concat(folder, target)), query))
    )


def same_site(a: Column, b: Column) -> Column:
    """Equal hosts, or one a sub-domain of the other."""
    dot = F.lit(".")
    return (a == b) | F.endswith(a, F.concat(dot, b)) | F.endswith(b, F.concat(dot, a))
