"""Chat corpora in XML by message: every `conversation` element keeps a key of its own, whatever its id and size.

The separator is `</message>`, so a piece holds one message and the conversation tags before it. A split's summary says
whether it has such tags, what is open behind the last one, and how many messages follow it; windows over the summaries
give the element that is open at the start of every split and the number of its messages so far. No element is collected:
one of any size is read by all splits that it spans.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatrisk.sources.pieces import per_split, read_pieces, summed_up, with_starts

_COMMENT = re.compile(r"<!--.*?-->", re.DOTALL)
_TAG = re.compile(r"""<(/?)(conversation|message)(?=[\s/>])((?:[^>"']|"[^"]*"|'[^']*')*)>""")


def events(piece: str) -> Iterator[tuple[str, str]]:
    """What a piece holds in order: ('open', attributes), ('close', ''), ('message', body); an element closed in its own
    tag gives both its events, a message without content an empty body."""
    piece = _COMMENT.sub("", piece)
    at = 0
    while tag := _TAG.search(piece, at):
        at = tag.end()
        closing, name, attributes = tag.groups()
        alone = attributes.endswith("/")
        if name == "message":
            if closing:
                raise ValueError(f"a message's end without its start: {piece[:80]!r}")
            yield "message", "" if alone else piece[at:]
            if not alone:
                return
        elif closing:
            yield "close", ""
        else:
            yield "open", attributes.rstrip("/")
            if alone:
                yield "close", ""
    if "<!--" in piece[at:]:
        raise ValueError(f"a comment that holds a message's end: {piece[at:][:80]!r}")


def _is_cut(piece: str) -> bool:
    """Whether the piece ends inside a message, as all but a file's last piece do."""
    last = None
    for tag in _TAG.finditer(_COMMENT.sub("", piece)):
        last = tag
        if tag[2] == "message" and not tag[3].endswith("/"):
            return True
    return last is not None and last[2] == "message" and not last[3].endswith("/")


def split_summary(first: bool, pieces: Iterator[str]) -> Iterator[tuple]:
    """(conversation tags here, an element is open at the end, its number in the split, its attributes, messages behind
    the last tag, the last piece ends inside a message)."""
    tags, still, number, attributes, n, cut, opened = False, None, None, None, 0, True, 0
    for piece in pieces:
        if not cut:
            raise ValueError(f"a message's end without its start, before {piece[:80]!r}")
        for kind, value in events(piece):
            if kind == "message":
                n += 1
                continue
            tags, n = True, 0
            still = kind == "open"
            number, attributes = (opened, value) if still else (None, None)
            opened += still
        cut = _is_cut(piece)
    yield tags, still, number, attributes, n, cut


def _parsed(text: str) -> ElementTree.Element:
    try:
        return ElementTree.fromstring(text)
    except ElementTree.ParseError as error:
        raise ValueError(f"malformed XML ({error}): {text[:80]!r}") from None


def split_messages(
    first: bool, pieces: Iterator[str], still: bool, opened: int | None, number: int | None, attributes: str | None, n: int,
) -> Iterator[tuple]:
    """(split that the element begins in, null for this one; its number there; id; position; author; text; is a message)
    of every message, and one row for an element without any."""
    def conv_id(text: str) -> str | None:
        return _parsed(f"<conversation {text}/>").get("id")

    current = [opened, number, conv_id(attributes), n] if still else None
    found = 0
    for piece in pieces:
        for kind, value in events(piece):
            if kind == "open":
                if current:
                    raise ValueError(f"a conversation inside another: {value!r}")
                current, found = [None, found, conv_id(value), 0], found + 1
            elif current is None:
                raise ValueError(f"outside a conversation: {kind} {value[:80]!r}")
            elif kind == "close":
                if not current[3]:
                    yield (*current, None, "", False)
                current = None
            else:
                message = _parsed(f"<message>{value}</message>")
                author, text = (message.find(name) for name in ("author", "text"))
                yield (*current, "" if author is None else author.text or "", "" if text is None else text.text or "", True)
                current[3] += 1


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """conv_key, conv_id, conv_idx, author, text_raw of every message, as written in the file (nothing stripped).

    `conv_key` names the element: file, byte position of its first split and number there. `conv_id` is null without an
    id attribute; of elements that share an id each has its own key. An element without messages has one row with a
    null author and an empty text. Malformed XML is an error; files are UTF-8. The first pass runs at once.
    """
    pieces = read_pieces(spark, path, "</message>")
    splits = summed_up(pieces, split_summary, "tags BOOLEAN, still BOOLEAN, number INT, attributes STRING, n BIGINT, cut BOOLEAN")
    here = Window.partitionBy("file").orderBy("block")
    last = F.struct("still", F.col("block").alias("opened"), "number", "attributes")
    placed = splits.withColumns({
        "state": F.last(F.when(F.col("tags"), last), ignorenulls=True).over(here.rowsBetween(Window.unboundedPreceding, 0)),
        "_run": F.sum(F.col("tags").cast("int")).over(here.rowsBetween(Window.unboundedPreceding, 0)),
        "_next": F.lead("block").over(here),
    })
    so_far = Window.partitionBy("file", "_run").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("_n", F.sum("n").over(so_far))
    ends = F.col("_next").isNull()
    broken = placed.filter((ends & (F.col("cut") | F.coalesce(F.col("state.still"), F.lit(False)))) | (~ends & ~F.col("cut")))
    if files := [r.file for r in broken.select("file").distinct().limit(3).collect()]:
        raise ValueError(f"XML whose elements are not closed: {files}")
    before = Window.partitionBy("file").orderBy("block")
    starts = placed.withColumns({"_state": F.lag("state").over(before), "_count": F.lag("_n").over(before)}).select(
        "file", "block", F.coalesce("_state.still", F.lit(False)).alias("still"), F.col("_state.opened").alias("opened"),
        F.col("_state.number").alias("number"), F.col("_state.attributes").alias("attributes"),
        F.coalesce("_count", F.lit(0)).cast("bigint").alias("n"))
    known = with_starts(pieces, starts)
    rows = per_split(
        known, split_messages,
        "opened BIGINT, number INT, conv_id STRING, conv_idx BIGINT, author STRING, text_raw STRING, is_message BOOLEAN",
        ["still", "opened", "number", "attributes", "n"])
    key = F.concat_ws("#", "file", F.coalesce("opened", "block").cast("string"), F.col("number").cast("string"))
    return rows.select(key.alias("conv_key"), "conv_id", F.col("conv_idx").cast("int").alias("conv_idx"), "author", "text_raw")
