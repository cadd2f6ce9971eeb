"""Body text of a mail: natively when it is plain UTF-8, else from the parts that one Arrow-batched stage decodes.

Python only undoes the MIME encoding and returns the text parts of a mail as they are. Which parts count, how they
are joined and how HTML becomes text are native columns.
"""

from __future__ import annotations

import html
import re
from email import message_from_bytes

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripledger.functions.html import html_to_text
from tripledger.functions.mail import header

_ENTITY = re.compile(r"&(?:#\d+|#[xX][0-9a-fA-F]+|\w+);?")
#: Characters that the native chain still has to tell from markup.
_MARKUP = {"<": "&lt;", ">": "&gt;", "&": "&amp;"}
_KINDS = {"text/plain": "plain", "text/html": "html"}


def settled(page: str) -> str:
    """A page whose entities are characters, but for the three that would look like markup."""
    return _ENTITY.sub(lambda m: (c := html.unescape(m[0])) and _MARKUP.get(c, c), page)


def text_parts(raw: bytes) -> list[tuple[str, str]]:
    """(kind, text) of the decoded text parts that are no attachments; kind ``bare`` is an undecodable single payload."""
    mail = message_from_bytes(raw)
    leaves = [p for p in mail.walk() if not p.is_multipart()]
    if mail.is_multipart():
        leaves = [p for p in leaves if "attachment" not in str(p["Content-Disposition"]).lower()]
    found = []
    for leaf in (p for p in leaves if p.get_content_type() in _KINDS):
        text = (leaf.get_payload(decode=True) or b"").decode(leaf.get_content_charset("utf-8"), "replace")
        kind = _KINDS[leaf.get_content_type()]
        found += [(kind, settled(text) if kind == "html" else text)] if text else []
    bare = mail.get_payload()
    return found or ([("bare", bare)] if isinstance(bare, str) else [])


_PART = T.StructType([T.StructField("kind", T.StringType()), T.StructField("text", T.StringType())])
_READ = T.StructType([T.StructField("parts", T.ArrayType(_PART)), T.StructField("error", T.StringType())])


@F.pandas_udf(_READ)
def _decoded(raw: pd.Series) -> pd.DataFrame:
    def one(item: bytes | None) -> tuple[list[dict[str, str]], str | None]:
        try:
            return [{"kind": k, "text": t} for k, t in text_parts(bytes(item))] if item is not None else [], None
        except Exception as problem:  # one bad mail must not end the job
            return [], f"{type(problem).__name__}: {problem}"

    return pd.DataFrame([one(item) for item in raw], columns=["parts", "error"])


def body_from(parts: Column) -> Column:
    """Plain parts joined by newlines, else the HTML parts as text, else the bare payload, else blank."""
    def texts(kind: str) -> Column:
        return F.transform(F.filter(parts, lambda p: p["kind"] == kind), lambda p: p["text"])

    pages = F.transform(texts("html"), html_to_text)
    return (
        F.when(F.size(texts("plain")) > 0, F.array_join(texts("plain"), "\n"))
        .when(F.size(pages) > 0, F.array_join(pages, "\n"))
        .otherwise(F.coalesce(F.get(texts("bare"), F.lit(0)), F.lit("")))
    )


def body_of(headers: Column, raw_body: Column, message: Column) -> Column:
    """Struct (body, error) of a mail.

    ``headers`` is the header text, ``raw_body`` the text after it and ``message`` the bytes
    of both. Only mails that need decoding are sent to Python; the others cross as NULL.
    """
    kind = F.lower(header(headers, "Content-Type"))
    transfer = F.lower(F.trim(header(headers, "Content-Transfer-Encoding")))
    charset = F.regexp_extract(kind, r'charset\s*=\s*"?([^\s;"]+)', 1)
    plain = (
        ((F.trim(kind) == "") | kind.startswith("text/plain"))
        & transfer.isin("", "7bit", "8bit", "binary")
        & charset.isin("", "utf-8", "utf8")
    )
    read = _decoded(F.when(~plain, message))
    decoded = F.struct(
        F.when(read["error"].isNull() & message.isNotNull(), body_from(read["parts"])).alias("body"), read["error"].alias("error"))
    native = F.struct(F.make_valid_utf8(raw_body).alias("body"), F.lit(None).cast("string").alias("error"))
    return F.when(plain, native).otherwise(decoded)
