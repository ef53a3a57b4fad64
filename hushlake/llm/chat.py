"""Operator 1: chat formatting as a prefix tree.

Conversations that begin with the same turns share the nodes of those turns. A node's id is a 16-byte digest chained over its turns from
the first on. Each node's segment is emitted once, depth first, into one stream, with its position ids (those of the conversation, not
of the stream) and the stream intervals of its ancestors: a token attends to those and to its own segment up to itself.

Nothing grows faster than the turns: no row holds a whole path. A conversation's key holds only its nodes at branches, those in
fewer conversations than their parent, most frequent child first. Conversations in the order of their keys, and nodes by the first
conversation that holds them and their depth, are the tree depth first. Ancestors that follow each other in the stream are one interval; as the
most frequent child comes first, intervals grow with the logarithm of the conversations. Digests are chained over rows
that stream by in order, so one conversation of any length costs a task time, not memory.

A segment is ``<|im_start|>role, newline, text, <|im_end|>, newline``. In roles and texts, control strings get an
escape after their first character, and the escape character itself is marked, so reading back gives the
text unchanged and no text can open or close a turn. The loss mask covers the text of assistant turns.

Defined results: a null text or role is empty; turns go by turn number, then role and text (null numbers first); rows without a conv_id
are one conversation; equal conversations share all nodes; an empty table gives an empty stream; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import ship, slices, written
from .tokens import encoder

#: Control strings of common templates, the template's own first.
CONTROLS = ["<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
OPEN, CLOSE = CONTROLS[0], CONTROLS[1] + "\n"
ESCAPE = "␛"
_control = re.compile(f"(?=(?:{'|'.join(map(re.escape, CONTROLS))}))(.)")

TURNS = "conv_id long, depth long, node binary, role string, text string"
KEYS = "leaf binary, key binary"
LOCAL = "part int, local_start long, local_number long, length long, node binary, rank long, depth int, segment string, loss_start int, loss_end int, ids array<long>"
DIGESTS = "leaf_start long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
#: So many node numbers are made in one row when a conversation is read back.
NUMBERS = 4096


def escape(text: str) -> str:
    return _control.sub(rf"\1{ESCAPE}1", text.replace(ESCAPE, ESCAPE + "0"))


def unescape(text: Column) -> Column:
    """Undo ``escape``, and the mark for a newline in a role."""
    for mark, plain in (("1", ""), ("2", "\n"), ("0", ESCAPE)):
        text = F.replace(text, F.lit(ESCAPE + mark), F.lit(plain))
    return text


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    for batch in batches:
        for part in slices(batch):
            yield part.to_pylist()


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns in order of conversation and turn to nodes."""
    last, digest, depth = None, b"", 0
    for turns in _rows(batches):
        out = []
        for turn in turns:
            if not depth or turn["conv_id"] != last:
                last, digest, depth = turn["conv_id"], b"", 0
            role, text = turn["role"], turn["text"]
            digest, depth = hashlib.blake2b(digest + f"{len(role)}:{role}{text}".encode(), digest_size=16).digest(), depth + 1
            out.append({"conv_id": last, "depth": depth, "node": digest, "role": role, "text": text})
        yield pa.RecordBatch.from_pylist(out, pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("node", pa.binary()), ("role", pa.string()), ("text", pa.string())]))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes in order of conversation and depth to a row for each conversation: its last node and its key."""
    shape = pa.schema([("leaf", pa.binary()), ("key", pa.binary())])
    leaf, key, before = None, bytearray(), -1
    for nodes in _rows(batches):
        out = []
        for node in nodes:
            if node["depth"] == 1:
                if leaf is not None:
                    out.append({"leaf": leaf, "key": bytes(key)})
                key, before = bytearray(), -1
            leaf, n = node["node"], node["n_convs"]
            if n != before:
                key += (2**63 - n).to_bytes(8, "big") + leaf
            before = n
        yield pa.RecordBatch.from_pylist(out, shape)
    if leaf is not None:
        yield pa.RecordBatch.from_pylist([{"leaf": leaf, "key": bytes(key)}], shape)


def _emit(tokenizer_path: str | None):
    shape = pa.schema([
        ("part", pa.int32()), ("local_start", pa.int64()), ("local_number", pa.int64()), ("length", pa.int64()), ("node", pa.binary()), ("rank", pa.int64()), ("depth", pa.int32()),
        ("segment", pa.string()), ("loss_start", pa.int32()), ("loss_end", pa.int32()), ("ids", pa.list_(pa.int64())),
    ])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, number = TaskContext.get().partitionId(), 0, 0
        for nodes in _rows(batches):
            segments, rows = [], []
            for node in nodes:
                role = node["role"]
                head = f"{OPEN}{escape(role).replace(chr(10), ESCAPE + '2')}\n"
                body = escape(node["text"])
                segments.append((head + body + CLOSE, len(head), len(head) + len(body) if role == "assistant" else len(head)))
            ids = encoder(tokenizer_path).encode_many([s for s, _, _ in segments]) if tokenizer_path else [None] * len(segments)
            for node, (segment, loss_start, loss_end), found in zip(nodes, segments, ids, strict=True):
                length = len(segment) if found is None else len(found) // 4
                numbers = None if found is None else memoryview(found).cast("I").tolist()
                rows.append(dict(zip(shape.names, (part, at, number, length, node["node"], node["rank"], node["depth"], segment, loss_start, loss_end, numbers), strict=True)))
                at, number = at + length, number + 1
            yield pa.RecordBatch.from_pylist(rows, shape)

    return emit


def format_conversations(turns: DataFrame, tokenizer_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The stream's segments, and each conversation's place in it; both are written tables.

    Segments: stream_start, number (in the stream), length, position (of the first token in its conversations), depth, segment, loss_start and loss_end
    (code points in the segment), ancestors (stream intervals in order, and the numbers of their first and last segments), ids. Tokens are code points,
    or, with ``tokenizer_path``, the ids of each segment. Conversations: conv_id, n_turns, leaf_start (stream_start of the last turn's segment).
    """
    ship(turns.sparkSession)
    plain = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    in_turn = plain.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    paths = written(in_turn.mapInArrow(_chain, TURNS), "chat-paths")
    ends = paths.groupBy("conv_id").agg(F.max_by("node", "depth").alias("leaf"), F.max("depth").cast("int").alias("n_turns"))

    # Conversations in the order of their keys; ranks rise in that order, with gaps.
    counts = paths.groupBy("node").agg(F.count(F.lit(1)).alias("n_convs"))
    known = paths.select("conv_id", "depth", "node").join(counts, "node").repartition("conv_id").sortWithinPartitions("conv_id", "depth")
    keys = written(known.select("depth", "node", "n_convs").mapInArrow(_keys, KEYS).groupBy("leaf").agg(F.first("key").alias("key")), "chat-keys")
    in_order = keys.repartitionByRange("key").sortWithinPartitions("key").select("leaf", F.monotonically_increasing_id().alias("rank"))
    ranks = written(in_order, "chat-ranks")
    convs = written(ends.join(ranks, "leaf").select(F.col("conv_id").alias("of"), "leaf", "n_turns", "rank"), "chat-conversations")
    ranked = paths.join(convs.select("of", "rank"), F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")

    first = ranked.groupBy("node").agg(F.min("rank").alias("rank"), F.first("depth").alias("depth"), F.first("role").alias("role"), F.first("text").alias("text"))
    ordered = first.repartitionByRange("rank", "depth").sortWithinPartitions("rank", "depth")
    local = written(ordered.mapInArrow(_emit(tokenizer_path), LOCAL), "chat-segments")
    # A row for each partition: where it starts.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = local.groupBy("part").agg(F.sum("length").alias("total"), F.count(F.lit(1)).alias("n"))
    parts = written(sums.select("part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(o) for c, o in (("total", "offset"), ("n", "numbered"))]), "chat-parts")
    placed = local.join(F.broadcast(parts), "part").withColumn("stream_start", F.col("offset") + F.col("local_start")).withColumn("number", F.col("numbered") + F.col("local_number"))

    # A conversation's nodes that one conversation was the first to hold follow each other in the stream.
    spots = placed.select("node", F.col("rank").alias("owner"), "stream_start", "length", "number")
    whole = ranked.select("rank", "node").join(spots, "node").groupBy("rank", "owner")
    runs = whole.agg(F.min("stream_start").alias("start"), F.max(F.col("stream_start") + F.col("length")).alias("end"), F.min("number").alias("first"), F.max("number").alias("last"))
    of = Window.partitionBy("rank").orderBy("first")
    apart = runs.withColumn("new", F.coalesce(F.lag("last").over(of) + 1 != F.col("first"), F.lit(True)).cast("long")).withColumn("island", F.sum("new").over(of))
    joined = apart.groupBy("rank", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("first").alias("first"), F.max("last").alias("last"))
    intervals = written(joined.groupBy("rank").agg(F.array_sort(F.collect_list(F.struct("start", "end", "first", "last"))).alias("runs")), "chat-intervals")

    def above(x: Column) -> Column:
        return F.struct(
            x["start"].alias("start"), F.least(x["end"], F.col("stream_start")).alias("end"), x["first"].alias("first"), F.least(x["last"], F.col("number") - 1).alias("last")
        )

    with_runs = placed.join(intervals, "rank").withColumn("ancestors", F.transform(F.filter("runs", lambda x: x["first"] < F.col("number")), above))
    position = F.aggregate("ancestors", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    segments = with_runs.select("node", "stream_start", "number", "length", position.alias("position"), "depth", "segment", "loss_start", "loss_end", "ancestors", "ids")
    segments = written(segments, "chat-stream")
    places = convs.join(segments.select(F.col("node").alias("leaf"), F.col("stream_start").alias("leaf_start")), "leaf").select(F.col("of").alias("conv_id"), "n_turns", "leaf_start")
    return segments.drop("node"), written(places, "chat-places")


def read_turns(segments: DataFrame, places: DataFrame) -> DataFrame:
    """Each distinct conversation's turns read back from the stream, a row each: leaf_start, k, role, text, loss_text, chars."""
    last = places.select("leaf_start").distinct().join(segments, F.col("leaf_start") == F.col("stream_start"))
    own = F.array(F.struct(F.col("number").alias("first"), F.col("number").alias("last")))
    runs = F.concat(F.transform("ancestors", lambda x: F.struct(x["first"].alias("first"), x["last"].alias("last"))), own)
    each = last.select("leaf_start", F.explode(runs).alias("run")).select("leaf_start", "run", F.explode(F.sequence("run.first", "run.last", F.lit(NUMBERS).cast("long"))).alias("at"))
    seen = each.select("leaf_start", F.explode(F.sequence("at", F.least(F.col("at") + NUMBERS - 1, F.col("run.last")))).alias("number"))
    head = F.length(F.lit(OPEN))
    body = F.substring("segment", head + 1, F.length("segment") - head - len(CLOSE))
    cut = F.instr(body, "\n")
    loss = F.substring("segment", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))
    return seen.join(segments.select("number", "depth", "segment", "loss_start", "loss_end"), "number").select(
        "leaf_start",
        (F.col("depth") - 1).alias("k"),
        unescape(F.substring(body, F.lit(1), cut - 1)).alias("role"),
        unescape(F.substring(body, cut + 1, F.length(body))).alias("text"),
        unescape(loss).alias("loss_text"),
        F.length("segment").alias("chars"),
    )


def read_conversations(segments: DataFrame, places: DataFrame) -> DataFrame:
    """Each distinct conversation in a row: leaf_start, turns (structs of role, text, loss_text), formatted_chars."""
    turn = F.struct("k", "role", "text", "loss_text", "chars")
    joined = read_turns(segments, places).select("leaf_start", turn.alias("turn"))
    return joined.groupBy("leaf_start").agg(F.array_sort(F.collect_list("turn")).alias("turns"), F.sum("turn.chars").alias("formatted_chars"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shape = pa.schema([("leaf_start", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    leaf, whole, loss, n_loss, chars = None, hashlib.sha256(), hashlib.sha256(), 0, 0

    def row() -> dict:
        return dict(zip(shape.names, (leaf, whole.hexdigest(), n_loss, loss.hexdigest(), chars), strict=True))

    for turns in _rows(batches):
        out = []
        for turn in turns:
            if turn["leaf_start"] != leaf:
                if leaf is not None:
                    out.append(row())
                leaf, whole, loss, n_loss, chars = turn["leaf_start"], hashlib.sha256(), hashlib.sha256(), 0, 0
            whole.update(f"{turn['role']}\n{turn['text']}\n".encode())
            loss.update(turn["loss_text"].encode())
            n_loss, chars = n_loss + len(turn["loss_text"]), chars + turn["chars"]
        yield pa.RecordBatch.from_pylist(out, shape)
    if leaf is not None:
        yield pa.RecordBatch.from_pylist([row()], shape)


def digest_conversations(segments: DataFrame, places: DataFrame) -> DataFrame:
    """Each distinct conversation's digests, made while its turns stream by: columns of DIGESTS."""
    ship(segments.sparkSession)
    return read_turns(segments, places).repartition("leaf_start").sortWithinPartitions("leaf_start", "k").mapInArrow(_digests, DIGESTS)


def op1_sql() -> str:
    """DuckDB SQL for the query's rows: each conversation formatted on its own."""
    angle = "|".join(re.escape(c[1:]) for c in CONTROLS if c[0] == "<")
    square = "|".join(re.escape(c[1:]) for c in CONTROLS if c[0] == "[")
    escaped = rf"regexp_replace(regexp_replace(replace({{}}, '{ESCAPE}', '{ESCAPE}0'), '(<)({angle})', '\1{ESCAPE}1\2', 'g'), '(\[)({square})', '\1{ESCAPE}1\2', 'g')"
    newline = f"replace({escaped.format('role')}, chr(10), '{ESCAPE}2')"
    return f"""
    WITH turn AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
    ), whole AS (
      SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
             coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
             sum({len(OPEN) + len(CLOSE) + 1} + length({newline}) + length({escaped.format("text")}))::BIGINT AS formatted_chars
      FROM turn GROUP BY conv_id
    )
    SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM whole"""
