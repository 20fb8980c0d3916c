"""Adjacent duplicate blocks of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame


def duplicate_blocks(lines: list[str], longest: int = 5, least: int = 8) -> list[tuple[int, int]]:
    """(first line from 1, block size) of blocks of ``longest`` down to 2 lines given twice in a row, greedily and without overlap.

    Each line of a block has at least ``least`` characters. Larger blocks come first; in a size, from the start.
    """
    n, taken, found = len(lines), bytearray(len(lines)), []
    fit = [len(x) >= least for x in lines]
    for size in range(longest, 1, -1):
        # run: how many lines up to here equal the line ``size`` before; a block given twice ends where it reaches ``size``
        run, free = 0, 0
        for end in range(n):
            free = 0 if taken[end] else free + 1
            run = run + 1 if end >= size and fit[end] and lines[end] == lines[end - size] else 0
            if run >= size and free >= 2 * size:
                start = end + 1 - 2 * size
                found.append((start + 1, size))
                taken[start : end + 1] = b"\x01" * (2 * size)
                run = free = 0
    return found


def adjacent_duplicates(docs: DataFrame, key: str, text: str) -> DataFrame:
    """A row for each block given twice in a row in a text's lines: key, first_line, block_size."""

    def find(batches):
        import pyarrow as pa

        for batch in batches:
            keys, firsts, sizes = [], [], []
            for i, x in enumerate(batch.column(text)):
                for first, size in duplicate_blocks(x.as_py().split("\n")) if x.is_valid else ():
                    keys.append(i)
                    firsts.append(first)
                    sizes.append(size)
            yield pa.record_batch([batch.column(key).take(pa.array(keys, pa.int64())), pa.array(firsts, pa.int32()), pa.array(sizes, pa.int32())], names=[key, "first_line", "block_size"])

    schema = docs.select(key).schema.add("first_line", "integer").add("block_size", "integer")
    return docs.select(key, text).mapInArrow(find, schema)
