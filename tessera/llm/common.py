"""What several operators share: the shared folder, tables, tokenizing and hashing."""

from __future__ import annotations

import os
import tempfile
import uuid
from codecs import charmap_decode
from string import punctuation

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import BASE, INVERSE, STRETCH, kept, mix64, powers, prefix_hash, span_hash  # noqa: F401  the operators take them from here
from ..functions.tasks import SCHEMES, arrow_uri, file_system, lean  # noqa: F401

_LOCAL: dict = {}
MADE: list[str] = []  # folders that this process's operators have made

# Settings for tasks that carry whole texts: small Arrow batches, scans and row groups; and for the driver, which builds what is broadcast: Spark goes
# by the bytes of files, of which numbers take many times as many there. Each is only set where it stands at Spark's own default.
BATCHES = {"spark.sql.autoBroadcastJoinThreshold": ("10485760b", "256k"), "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "500"), "spark.sql.execution.arrow.maxBytesPerBatch": (None, "4194304"), "spark.sql.parquet.columnarReaderBatchSize": ("4096", "512"), "parquet.block.size": (None, "16777216")}


def small_batches(spark: SparkSession) -> None:
    """Bound what a task holds of long texts at a time; settings that the session already has stay."""
    if _LOCAL.get("session") is spark:
        return
    _LOCAL["session"] = spark
    explicit = {r.key for r in spark.sql("SET").collect()}
    for key, (usual, wanted) in BATCHES.items():
        if key not in explicit or usual and spark.conf.get(key) == usual:
            spark.conf.set(key, wanted)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``. Where that is unset, a local one will do for a local master (tests), and nothing else."""
    small_batches(spark)
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = _LOCAL.setdefault("dir", tempfile.mkdtemp(prefix="tessera-"))
    if "://" not in base and not base.startswith("file:"):
        base = f"file://{base}"
    MADE.append(f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return MADE[-1]


def dropped(spark: SparkSession, folders: list[str]) -> None:
    """Delete folders of the shared store that nothing reads any more."""
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        if folder in MADE:
            MADE.remove(folder)


def stored(df: DataFrame, name: str, codec: str = "zstd", instead_of: DataFrame | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts the lineage, and lost executors cost no recomputation.

    ``instead_of``: a stored table that ``df`` is made of and nothing else needs; it goes when ``df`` is written.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.option("compression", codec).parquet(path)
    if instead_of is not None:
        dropped(spark, [instead_of._stored])
    out = spark.read.schema(df.schema).parquet(path)
    out._stored = path
    return out


def dealt_join(left: DataFrame, right: DataFrame, keys: list[str], weight: str, rows: int, how: str = "inner", most: int = 500) -> DataFrame:
    """Join ``right``, which has each key once and in ``weight`` the number of ``left``'s rows that have it (``rows`` in all).

    Keys with over a ``most``-th of the rows can't be more than ``most``, so that part of ``right`` is broadcast, whatever the corpus;
    of the other keys none fills a task, so they are shuffled.
    """
    limit = max(1, rows // most)
    heavy, light = right.filter(F.col(weight) > limit).drop(weight), right.filter(F.col(weight) <= limit).drop(weight)
    names = [c for c in right.columns if c not in (*keys, weight)]
    met = left.join(F.broadcast(heavy.withColumn("dealt_heavy", F.lit(True))), keys, "left")
    first = met.filter("dealt_heavy").drop("dealt_heavy")
    rest = met.filter("dealt_heavy is null").drop("dealt_heavy", *names).join(light, keys, how)
    return first.unionByName(rest)


class Filed:
    """A table in the shared folder whose row numbers ``rid`` hold their file's number (rid >> 33), in small row groups.

    Small rows about its rows are dealt out by file number, so a task reads files and what belongs to them, and large columns are
    never shuffled. Of a file, only row groups with a wanted row are read, and of files without one, nothing.

    A task writes one file whatever ``spark.sql.files.maxRecordsPerFile`` says; where a number has several all the same, they are
    read in order of their names, and a wanted row that no file has is an error.
    """

    #: Bytes of files that a task reads; as many tasks as shuffles have partitions at least.
    TASK_BYTES = 256 << 20

    def __init__(self, df: DataFrame, name: str, codec: str = "snappy"):
        self.spark, self.schema = df.sparkSession, df.schema
        self.path = shared_dir(self.spark, name)
        df.write.option("compression", codec).option("parquet.block.size", 4 << 20).option("maxRecordsPerFile", 0).parquet(self.path)
        self.rows = self.spark.read.schema(df.schema).parquet(self.path)
        self.numbers = self.rows.select(F.expr("shiftright(rid, 33)").alias("pid")).distinct()
        self.files = (self.numbers.agg(F.max("pid")).first()[0] or 0) + 1
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        size = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
        self.n_tasks = min(self.files, max(-(-size // self.TASK_BYTES), int(self.spark.conf.get("spark.sql.shuffle.partitions"))))

    def tasks(self, beside: DataFrame, all_files: bool = False) -> DataFrame:
        """``beside`` (columns rid and others), dealt out by file and sorted by rid, pid first; ``all_files``: with a row of rid -1 for every file.

        Neighbouring files go to a task together, so there are as many tasks as the bytes ask for, however many files there are.
        """
        rows = beside.withColumn("pid", F.expr("shiftright(rid, 33)"))
        if all_files:
            rows = rows.unionByName(self.numbers.withColumn("rid", F.lit(-1).cast("long")), allowMissingColumns=True)
        rows = rows.select("pid", *beside.columns)
        task = F.expr(f"cast(pid * {self.n_tasks} div {self.files} as int)")
        return rows.repartitionById(self.n_tasks, task).sortWithinPartitions("pid", "rid")

    def reader(self, columns: list[str], every: bool = False):
        """A function for mapInArrow over ``tasks``: yields (columns of ``beside`` as arrays, record batch of the file's wanted rows) in file order.

        With ``every``, all rows of a file come, wanted or not.
        """
        path = self.path

        def run(batches):
            from pyarrow import fs as pafs

            fs, root = file_system(path)
            files: dict = {}
            for x in sorted(fs.get_file_info(pafs.FileSelector(root)), key=lambda x: x.base_name):
                if x.path.endswith(".parquet"):
                    files.setdefault(int(x.base_name.split("-")[1]), []).append(x.path)
            for pid, beside in by_file(batches):
                wanted = np.unique(beside["rid"][beside["rid"] >= 0])
                missing = len(wanted)
                for path_of in files[pid]:
                    for found, part in rows_of(fs, path_of, wanted):
                        missing -= found
                        if part.num_rows:
                            yield beside, part
                if missing:
                    raise ValueError(f"{missing} rows of file {pid} of {path} are gone")

        def rows_of(fs, path_of, wanted):
            import pyarrow.parquet as pq

            with fs.open_input_file(path_of) as f:
                file = pq.ParquetFile(f)
                number = next(i for i in range(file.metadata.num_columns) if file.metadata.schema.column(i).path == "rid")  # leaves, not fields
                for group in range(file.num_row_groups):
                    s = file.metadata.row_group(group).column(number).statistics
                    lo, hi = np.searchsorted(wanted, [s.min, s.max + 1])
                    if lo == hi and not every:
                        continue
                    for part in file.iter_batches(batch_size=256, row_groups=[group], columns=["rid", *columns]):
                        here = np.isin(part.column("rid").to_numpy(), wanted[lo:hi])
                        yield int(here.sum()), part if every else part.filter(pa_bool(here))

        return run


def pa_bool(mask: np.ndarray):
    import pyarrow as pa

    return pa.array(mask, pa.bool_())


def by_file(batches):
    """(pid, {column: array}) for each run of equal pid in a task's sorted rows."""
    pid, held = None, []

    def joined():
        return {c: np.concatenate([h[c] for h in held]) for c in held[0]}

    for batch in batches:
        pids = batch.column("pid").to_numpy()
        columns = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names if c != "pid"}
        for own in np.split(np.arange(len(pids)), np.flatnonzero(np.diff(pids)) + 1):
            if not len(own):
                continue
            if pids[own[0]] != pid and held:
                yield pid, joined()
                held = []
            pid = int(pids[own[0]])
            held.append({c: x[own] for c, x in columns.items()})
    if held:
        yield pid, joined()


def slices(batch, column: str = "text", rows: int = 200, size: int = 1 << 20):
    """A batch in slices of at most ``rows`` rows and about ``size`` bytes of ``column``, or one row."""
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    long = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    begin, held = 0, 0
    for i, n in enumerate(long):
        if i > begin and (i - begin >= rows or held + n > size):
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += int(n)
    yield batch.slice(begin)


def gathered(batches):
    """A task's batches as a table; None if there are no rows."""
    import pyarrow as pa

    batches = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(batches) if batches else None


def utf8(column: str = "text"):
    """The text's UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")


def whole(tokenizer, text: str) -> bytes:
    return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


# ASCII characters, by byte: white space, letters, and punctuation that is cut off the letters before it (an apostrophe may be of a token with them).
BLANK, LETTER, MARK = (np.array([b < 128 and good(chr(b)) for b in range(256)]) for good in (str.isspace, str.isalpha, lambda c: c in punctuation and c != "'"))
# White space beyond ASCII, as UTF-8.
WIDE_BLANKS = [c.encode() for c in map(chr, range(128, 0x3001)) if c.isspace()]


def blanks(data: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 text belong to white space."""
    blank = BLANK[data]
    for head in sorted({x[0] for x in WIDE_BLANKS}):
        at = np.flatnonzero(data == head)
        for wide in WIDE_BLANKS if len(at) else ():
            if wide[0] == head:
                here = at[at + len(wide) <= len(data)]
                for k, byte in enumerate(wide[1:], 1):
                    here = here[data[here + k] == byte]
                for k in range(len(wide)):
                    blank[here + k] = True
    return blank


def joints(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where pieces begin in the UTF-8 bytes of texts that begin at ``starts``: see ``Encoder``."""
    blank = blanks(data)
    follows = np.r_[blank[1:], True]  # white space, or a text's end, follows
    follows[starts[1:] - 1] = True
    cut = (data == 32) & ~follows
    feed = np.flatnonzero((data == 10) & ~follows)
    feed = feed[feed > 0]
    feed = feed[~blank[feed - 1] & ~np.isin(feed, starts)]
    cut[feed] = cut[feed + 1] = True
    mark = np.flatnonzero(MARK[data])
    mark = mark[mark > 1]
    last, before = data[mark - 1], data[mark - 2]
    latin = (before == 0xC3) & (last != 0x97) & (last != 0xB7)  # letters from U+00C0 to U+00FF
    cut[mark[LETTER[last] | latin]] = True
    cut[starts] = True
    return np.flatnonzero(cut)


class Encoder:
    """ids of whole texts by the ``tokenizers`` library, as little-endian uint32 bytes.

    Byte-level pre-tokenization always cuts before a space that precedes a non-space, between a letter and punctuation that follows it,
    and makes a token of its own of a line feed between non-spaces. Texts fall into pieces there; each different piece of a call is
    looked up once, and those not seen lately go to the library. The ids are those of the whole text. A text that holds the string
    of an added token goes to the library whole, as the token ends a run of spaces before it. ``most`` bounds the number of pieces
    kept, of 64 characters at most each.
    """

    def __init__(self, path: str, most: int = 200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.most = self.tokenizer.model, most
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # pieces that weren't looked up since ``known`` was begun
        # byte-level alphabet: printable bytes stand for themselves, the others for the code points from 256 on, in order
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        self.alphabet = "".join([hidden.get(b, chr(b)) for b in range(256)])
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)  # ids of tokens that begin with a space
        self.spaced[[i for t, i in vocabulary.items() if t[:1] == hidden[32]]] = True
        self.together = 1 if getattr(self.model, "ignore_merges", False) else 64  # words that the model gets at once

    def __call__(self, texts: list) -> list[bytes]:
        out, some = [b""] * len(texts), []
        for i, text in enumerate(texts):
            if text and any(a in text for a in self.added):
                out[i] = whole(self.tokenizer, text)
            elif text:
                some.append(i)
        if some:
            for i, ids in zip(some, self.pieced([texts[i].encode() for i in some])):
                out[i] = ids
        return out

    def pieced(self, texts: list[bytes]) -> list[bytes]:
        """ids of texts that aren't empty."""
        import pyarrow as pa

        data = b"".join(texts)
        starts = np.cumsum([0] + [len(x) for x in texts])
        at = joints(np.frombuffer(data, np.uint8), starts[:-1])
        ends = np.r_[at, len(data)]
        pieces = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(data)]).dictionary_encode()
        ids = self.looked_up(pieces.dictionary.to_numpy(zero_copy_only=False).tolist())
        long = np.array([len(x) // 4 for x in ids])
        flat, begin = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(long) - long
        which = pieces.indices.to_numpy()
        long, begin = long[which], begin[which]
        upto = np.r_[0, np.cumsum(long)]
        made = flat[np.repeat(begin - upto[:-1], long) + np.arange(upto[-1])].tobytes()
        bounds = 4 * upto[np.searchsorted(ends, starts)]
        return [made[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]

    def looked_up(self, pieces: list[str]) -> list[bytes]:
        """ids of different pieces."""
        out, older, words, others = list(map(self.known.get, pieces)), self.older.get, [], []
        fresh = [i for i, x in enumerate(out) if x is None]
        for i in fresh:
            piece = pieces[i]
            ids = out[i] = older(piece)
            if ids is None:
                (words if piece[0] == " " and piece[1:].isalpha() else others).append(i)
        for k in range(0, len(words), self.together):
            some = words[k : k + self.together]
            for i, ids in zip(some, self.words([pieces[i] for i in some])):
                out[i] = ids
        for i in others:
            out[i] = self.letters(pieces[i]) if pieces[i].isalpha() else whole(self.tokenizer, pieces[i])
        half = self.most // 2
        if len(self.known) + len(fresh) > half:
            self.known, self.older = {}, self.known
        self.known.update((pieces[i], out[i]) for i in fresh[:half] if len(pieces[i]) <= 64)  # long pieces hardly come twice
        return out

    def letters(self, word: str) -> bytes:
        """ids of letters, with a space in front or not: pre-tokenization makes one token of them, so the library's model is asked directly."""
        shown = charmap_decode(word.encode(), "strict", self.alphabet)[0]
        return np.array([t.id for t in self.model.tokenize(shown)], "<u4").tobytes()

    def words(self, words: list[str]) -> list[bytes]:
        """ids of words of letters with a space in front, which the model gets in one text.

        Merged tokens are never taken apart, so if each word begins with a token that begins with its space, no merge went over a
        word's end, and each word's merges were its own.
        """
        made = self.letters("".join(words))
        at = 4 * np.flatnonzero(self.spaced[np.frombuffer(made, "<u4")])
        if len(at) != len(words):
            return list(map(self.letters, words))
        return [made[a:b] for a, b in zip(at.tolist(), [*at[1:].tolist(), len(made)])]


def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary file and worker process."""
    return kept(f"encoder {path}", lambda: Encoder(path))


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
