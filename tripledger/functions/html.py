"""HTML to plain text as a chain of native replacements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# End tags (and self-closing forms) that break the text, and the entities resolved natively.
BREAKING_TAGS = ("br", "p", "div", "tr", "li", "h1", "h2", "h3", "h4")
ENTITIES = {
    "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": "\xa0",
    "&copy;": "©", "&middot;": "·", "&amp;": "&",
}


def html_to_text(html: Column) -> Column:
    """Comments, scripts and styles dropped, breaking end tags to spaces, entities resolved.

    Knows the entities above only; ``functions.mime.settled`` turns the others into characters first.
    """
    tags = "|".join(BREAKING_TAGS)
    steps = (
        (r"(?s)<!--.*?-->", ""),
        (r"(?is)<script\b[^>]*>.*?</script\s*>", ""),
        (r"(?is)<style\b[^>]*>.*?</style\s*>", ""),
        (rf"(?i)</(?:{tags})\s*>|<(?:{tags})(?:\s[^>]*)?/>", " "),
        (r"<[^>]+>", ""),
    )
    text = html
    for pattern, put in steps:
        text = F.regexp_replace(text, pattern, put)
    for name, char in ENTITIES.items():
        text = F.replace(text, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
