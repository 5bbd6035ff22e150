"""A Spark data source for families of CSV files whose headers may differ.

Every partition opens its files on an executor, reads each file's own header
and takes the wanted columns by name, so nothing but the listing happens on
the driver.  Small files share a partition; a large plain file is cut into
byte ranges at line ends, as Spark's own readers do; a compressed file, or one
whose values may span lines, is one partition.  Paths are taken literally.

Values come as strings (an empty unquoted value is NULL) with the path they
were read from; the caller casts them in the plan.  A row with too few values
is filled up with NULL, surplus values are dropped.
"""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlsplit

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: What opening a file counts for when small files are put together, in bytes.
OPEN_COST = 4 << 20
#: The header must end within so many bytes.
HEADER_LIMIT = 1 << 20
#: Endings that are decompressed on reading; such files are not cut.
COMPRESSED = (".gz", ".bz2", ".zst", ".lz4")
#: Schemes that executors open themselves.
SCHEMES = ("", "file", "s3", "s3a", "gs", "hdfs", "abfss")


def opens(path: str) -> bool:
    """Whether executors can open files like this one without Spark's own readers."""
    return urlsplit(path).scheme in SCHEMES


def _file_system(path: str):
    from pyarrow import fs

    scheme, rest = path.split(":", 1) if ":" in path.split("/", 1)[0] else ("", path)
    if scheme in ("", "file"):
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    authority, _, key = rest.lstrip("/").partition("/")
    system, base = fs.FileSystem.from_uri(f"{'s3' if scheme == 's3a' else scheme}://{authority}/")
    return system, f"{base.rstrip('/')}/{key}"


@dataclass
class Piece:
    """The rows of a file that start in [start, end); end -1: the whole file, as a stream."""

    path: str
    start: int
    end: int


class Pieces(InputPartition):
    def __init__(self, pieces: list[Piece]):
        self.pieces = pieces


class _Chained(io.RawIOBase):
    """Bytes read ahead, then the rest of a stream."""

    def __init__(self, head: bytes, rest):
        self.head, self.rest = head, rest

    def readable(self) -> bool:
        return True

    def read(self, n: int = -1) -> bytes:
        if self.head:
            got, self.head = (self.head, b"") if n is None or n < 0 else (self.head[:n], self.head[n:])
            return got if n is not None and n >= 0 else got + self.rest.read()
        return self.rest.read() if n is None or n < 0 else self.rest.read(n)


def split_header(data: bytes) -> tuple[list[str], int]:
    """Column names in the first line, and where the line after it begins."""
    ends = [i for i in (data.find(b"\n"), data.find(b"\r")) if i >= 0]
    end = min(ends, default=len(data))
    after = end + 2 if data[end : end + 2] == b"\r\n" else min(end + 1, len(data))
    line = data[:end].removeprefix(b"\xef\xbb\xbf").decode("utf-8", "replace")
    return next(csv.reader([line]), []), after


class CsvReader(DataSourceReader):
    def __init__(self, options: dict):
        self.fields: list[str] = json.loads(options["fields"])
        self.files: list = json.loads(options["files"])
        self.per: int = int(options["bytes"])
        self.multi_line = options.get("multiline", "false") == "true"
        self.key: str | None = options.get("key")

    def partitions(self) -> list[Pieces]:
        out: list[Pieces] = []
        held, size = [], 0
        for path, length in self.files:
            whole = self.multi_line or path.endswith(COMPRESSED)
            if not whole and length > self.per:
                out += [Pieces([Piece(path, at, min(at + self.per, length))]) for at in range(0, length, self.per)]
                continue
            if held and size + length + OPEN_COST > max(self.per, OPEN_COST):
                out.append(Pieces(held))
                held, size = [], 0
            held.append(Piece(path, 0, -1 if whole else length))
            size += length + OPEN_COST
        return [*out, Pieces(held)] if held else out

    def read(self, partition: Pieces) -> Iterator:
        for piece in partition.pieces:
            yield from self._read(piece)

    # --- one piece -----------------------------------------------------------

    def _places(self, path: str, header: list[str]) -> list[int]:
        missing = [f for f in self.fields if f not in header]
        if missing:
            raise ValueError(f"columns {missing} are missing in {path}: its header is {header}")
        return [header.index(f) for f in self.fields]

    def _read(self, piece: Piece) -> Iterator:
        system, path = _file_system(piece.path)
        if piece.end < 0:
            with system.open_input_stream(path, compression="detect") as stream:
                head = stream.read(HEADER_LIMIT)
                header, after = split_header(head)
                if header:
                    yield from self._parse(piece.path, header, _Chained(head[after:], stream))
            return
        with system.open_input_file(path) as f:
            header, begin = split_header(f.read(HEADER_LIMIT))
            if not header:
                return
            if piece.start > 0:
                begin = max(begin, self._line_start(f, piece.start))
            if begin >= piece.end:
                return
            f.seek(begin)
            data = f.read(piece.end - begin)
            # the last row that starts here ends where the next piece's first one begins
            if not data.endswith(b"\n"):
                tail = []
                while more := f.read(1 << 16):
                    cut = more.find(b"\n")
                    tail.append(more if cut < 0 else more[: cut + 1])
                    if cut >= 0:
                        break
                data += b"".join(tail)
        yield from self._parse(piece.path, header, io.BytesIO(data))

    @staticmethod
    def _line_start(f, at: int) -> int:
        """Where the first line that starts at ``at`` or later begins."""
        f.seek(at - 1)
        at -= 1
        while more := f.read(1 << 16):
            cut = more.find(b"\n")
            if cut >= 0:
                return at + cut + 1
            at += len(more)
        return at

    def _parse(self, path: str, header: list[str], rows) -> Iterator:
        import pyarrow as pa
        from pyarrow import csv as pc

        names = [f"c{i}" for i in range(len(header))]
        wanted = [names[i] for i in self._places(path, header)]
        odd: list[str] = []

        def ragged(row) -> str:
            odd.append(row.text)
            return "skip"

        try:
            reader = pc.open_csv(
                pa.PythonFile(rows, mode="r"),
                read_options=pc.ReadOptions(column_names=names, use_threads=False, block_size=8 << 20),
                parse_options=pc.ParseOptions(newlines_in_values=self.multi_line, invalid_row_handler=ragged),
                convert_options=pc.ConvertOptions(
                    include_columns=list(dict.fromkeys(wanted)), column_types={n: pa.string() for n in wanted}, null_values=[""],
                    strings_can_be_null=True, quoted_strings_can_be_null=False),
            )
        except pa.ArrowInvalid as e:
            if "Empty CSV" not in str(e):
                raise
            reader = []                       # a header and no complete row
        for batch in reader:
            yield self._batch(path, [batch.column(n) for n in wanted], batch.num_rows)
            if odd:
                yield self._odd(path, header, odd)
                odd.clear()
        if odd:
            yield self._odd(path, header, odd)

    def _odd(self, path: str, header: list[str], texts: list[str]):
        import pyarrow as pa

        rows = [r for t in texts for r in csv.reader(io.StringIO(t, newline=""))]
        columns = [pa.array([(r[i] or None) if i < len(r) else None for r in rows], pa.string()) for i in self._places(path, header)]
        return self._batch(path, columns, len(rows))

    def _batch(self, path: str, columns: list, n: int):
        import pyarrow as pa

        more = [pa.array([path] * n, pa.string())]
        names = [f"c{i}" for i in range(len(columns))] + ["_file"]
        if self.key:
            more.append(pa.array([self._key_of(path)] * n, pa.string()))
            names.append("_key")
        return pa.RecordBatch.from_arrays([*columns, *more], names=names)

    def _key_of(self, path: str) -> str | None:
        """The value of the ``key=`` folder a file lies in."""
        for part in reversed(path.split("/")[:-1]):
            if part.startswith(f"{self.key}="):
                value = unquote(part[len(self.key) + 1 :])
                return None if value == "__HIVE_DEFAULT_PARTITION__" else value
        raise ValueError(f"{path} lies in no folder {self.key}=...")


class CsvFamily(DataSource):
    """Options: files (JSON list of [path, length]), fields (JSON list), bytes (per partition), multiline, key."""

    @classmethod
    def name(cls) -> str:
        return "leafwise_csv"

    def schema(self) -> str:
        columns = [f"c{i} string" for i in range(len(json.loads(self.options["fields"])))] + ["_file string"]
        return ", ".join(columns + (["_key string"] if self.options.get("key") else []))

    def reader(self, schema) -> CsvReader:
        return CsvReader(self.options)
