"""Structure files and line files as data sources of Spark: ``spark.read.format("structure")`` and
``df.write.format("line_files")``.

Both reach any store that Arrow's file systems know by URI. The reader makes a partition of a pack of files; filters on
equality or membership are taken over by it: those on the structure choose files, those on what names an atom
are tested before anything is parsed. The writer puts every file under a temporary name and renames them when
all tasks have ended; where one fails, none stays.
"""

from __future__ import annotations

import fnmatch
import gzip
import re
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .. import schema
from . import structures

PACK_BYTES = 8 << 20  # files of a partition
#: Columns a filter on which the reader takes over; those before the bar are known before altlocs are resolved.
NAMING = ("structure_id", "model", "chain", "resname", "resnum", "icode", "atom_name")
OTHER = ("hetflag", "element", "altloc")


def register(spark: SparkSession) -> None:
    """Make both formats known to the session; filters reach Python sources only if the session lets them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Structures)
    spark.dataSource.register(LineFiles)


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:/") else (fs.LocalFileSystem(), path)


def find_files(path: str) -> list[tuple[str, int]]:
    """(path, size) of the files a path names: one file, all below a folder, or those whose names fit a pattern in the last
    part. One listing a folder."""
    store, where = _place(path)
    folder, _, pattern = where.rpartition("/")
    glob = any(c in pattern for c in "*?[")
    info = store.get_file_info(folder if glob else where)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [(where, info.size)]
    found = store.get_file_info(fs.FileSelector(info.path, recursive=not glob))
    keep = (lambda n: fnmatch.fnmatchcase(n, pattern)) if glob else (lambda n: re.search(structures._SUFFIX, n, re.IGNORECASE))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and keep(f.base_name))


@dataclass
class Pack(InputPartition):
    """Some files of a store, by the path that names the store."""

    root: str
    files: list[str]


class Structures(DataSource):
    """``format("structure")``: atoms of PDB and mmCIF files, also gzipped, in the columns of ``schema.ATOM``. Options: path;
    altloc (``true``: alternative locations are resolved)."""

    @classmethod
    def name(cls) -> str:
        return "structure"

    def schema(self) -> str:
        return schema.ATOM

    def reader(self, schema: StructType) -> StructureReader:
        return StructureReader(self.options)


class StructureReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.altloc = options["path"], options.get("altloc", "true").lower() == "true"
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if column not in NAMING + OTHER:
                yield f
                continue
            values = set(f.value) if isinstance(f, In) else {f.value}
            self.wanted[column] = self.wanted[column] & values if column in self.wanted else values

    def partitions(self) -> Sequence[InputPartition]:
        packs: list[Pack] = []
        size = 0
        for path, n in find_files(self.path):
            if "structure_id" in self.wanted and _stem(path) not in self.wanted["structure_id"]:
                continue
            if not packs or size + n > PACK_BYTES:
                packs.append(Pack(self.path, []))
                size = 0
            packs[-1].files.append(path)
            size += n
        return packs or [Pack(self.path, [])]

    def read(self, partition: Pack) -> Iterator[pa.RecordBatch]:
        types = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
        kind = pa.schema([(n, types[t]) for n, t in (c.split() for c in schema.ATOM.split(", "))])
        store, _ = _place(partition.root)
        for path in partition.files:
            with store.open_input_stream(path, compression=None) as f:
                raw = f.read()
            text = (gzip.decompress(raw) if path.endswith(".gz") else raw).decode("utf-8", "replace")
            lines = re.search(r"\.(pdb|ent)(\.gz)?$", path, re.IGNORECASE)
            rows = list(self.chosen((pdb_atoms if lines else cif_atoms)(text, self.early), _stem(path)))
            for i in range(0, len(rows), 20_000):
                part = list(zip(*rows[i : i + 20_000], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(part, kind.types, strict=True)], schema=kind)

    def early(self, model: int, chain: str, resname: str, resnum: int | None, icode: str, atom_name: str) -> bool:
        have = dict(zip(NAMING[1:], (model, chain, resname, resnum, icode, atom_name), strict=True))
        return all(have[c] in v for c, v in self.wanted.items() if c in have)

    def chosen(self, atoms: Iterable[tuple], name: str) -> Iterator[tuple]:
        """Rows of a file behind its name, of several locations of an atom the one of highest occupancy, the first of
        equal ones."""
        best: dict[tuple, tuple] = {}
        late = [(k, self.wanted[c]) for c, k in (("hetflag", 2), ("element", 8), ("altloc", 7)) if c in self.wanted]
        out = []
        for r in atoms:
            if self.altloc and r[7]:
                key = (r[0], r[1], *r[3:7])
                if key not in best or r[12] > best[key][12]:
                    best[key] = r
            else:
                out.append(r)
        for r in sorted([*out, *best.values()], key=lambda r: r[-1]):
            if all(r[k] in v for k, v in late):
                yield (name, *r)


def _stem(path: str) -> str:
    return re.sub(structures._SUFFIX, "", path.rpartition("/")[2], flags=re.IGNORECASE)


def _float(s: str) -> float | None:
    try:
        return float(pa.scalar(float(s), pa.float32()).as_py())
    except ValueError:
        return None


def _int(s: str | None) -> int | None:
    return int(s) if s and re.fullmatch(r"[+-]?\d+", s) else None


def _element(given: str, name: str) -> str:
    letters = re.sub(r"[^A-Za-z]", "", name[:2]).upper()
    if given.strip():
        return given.strip().upper()
    return letters[:1] if re.match(r"[ 0-9]", name[:1]) else letters[:1] if len(name.strip()) == 4 else letters


Early = Callable[[int, str, str, "int | None", str, str], bool]


def pdb_atoms(text: str, wanted: Early) -> Iterator[tuple]:
    """(model, chain, hetflag, resname, resnum, icode, atom_name, altloc, element, x, y, z, occupancy, ordinal) of the
    coordinate lines of a PDB file; ``ordinal`` counts parts that begin with MODEL, and lines within."""
    model = part = start = 0
    for n, line in enumerate(re.split(r"\r?\n", text)):
        if line.startswith("MODEL "):
            part, start = part + (n > 0), n
            given = _int(line[6:14].strip())
            model = (1 if given is None else given) - 1
        if line[:6] not in ("ATOM  ", "HETATM"):
            continue
        chain, resname, icode, name = line[21:22].strip(), line[17:20].strip(), line[26:27].strip(), line[12:16]
        resnum = _int(line[22:26].strip())
        if not wanted(model, chain, resname, resnum, icode, name.strip()):
            continue
        xyz = [_float(line[a : a + 8]) for a in (30, 38, 46)]
        if None in xyz:
            continue
        flag = " " if line[:6] == "ATOM  " else "W" if resname in ("HOH", "WAT") else "H"
        try:
            occupancy = float(line[54:60])
        except ValueError:
            occupancy = 1.0
        yield (model, chain, flag, resname, resnum, icode, name.strip(), line[16:17].strip(), _element(line[76:78], name), *xyz, occupancy, (part << 32) + n - start)


def cif_atoms(text: str, wanted: Early) -> Iterator[tuple]:
    """The same of the ``_atom_site`` loops of an mmCIF file; ``ordinal`` is the row."""
    for n, r in enumerate(structures.atom_site(text)):
        get = lambda a, b="": r.get(a) or (r.get(b) if b else None)  # noqa: B023, E731
        chain, resname, name = get("auth_asym_id", "label_asym_id") or "", get("auth_comp_id", "label_comp_id"), get("auth_atom_id", "label_atom_id")
        given = _int(get("pdbx_pdb_model_num"))
        model, resnum = (1 if given is None else given) - 1, _int(get("auth_seq_id", "label_seq_id"))
        icode = get("pdbx_pdb_ins_code") or ""
        if not wanted(model, chain, resname, resnum, icode, name):
            continue
        xyz = [_float(get(f"cartn_{c}") or "") for c in "xyz"]
        if None in xyz:
            continue
        flag = " " if get("group_pdb") == "ATOM" else "W" if resname in ("HOH", "WAT") else "H"
        try:
            occupancy = float(get("occupancy") or "")
        except ValueError:
            occupancy = 1.0
        yield (model, chain, flag, resname, resnum, icode, name, get("label_alt_id") or "", _element(get("type_symbol") or "", name or ""), *xyz, occupancy, n)


# ---------------------------------------------------------------- line files


@dataclass
class Written(WriterCommitMessage):
    """(temporary, final) names of the files a task wrote."""

    files: list[tuple[str, str]]


class LineFiles(DataSource):
    """``format("line_files")``: rows (path, ordinal, value) as text files, each ``value`` a line of the file at ``path``. All
    rows of a path have to be in one task, in order. Option ``path``: a folder for temporary names, in the same store."""

    @classmethod
    def name(cls) -> str:
        return "line_files"

    def schema(self) -> str:
        return "path string, ordinal long, value string"

    def writer(self, schema: StructType, overwrite: bool) -> LineWriter:
        return LineWriter(self.options["path"])


class LineWriter(DataSourceArrowWriter):
    def __init__(self, work: str):
        self.work = f"{work.rstrip('/')}/.lines-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = _place(self.work)
        store.create_dir(root, recursive=True)
        files: list[tuple[str, str]] = []
        out, now = None, None
        try:
            for batch in iterator:
                for path, value in zip(batch.column("path").to_pylist(), batch.column("value").to_pylist(), strict=True):
                    if path != now:
                        if out:
                            out.close()
                        if path in {f for _, f in files}:
                            raise ValueError(f"rows of {path} are not in a row")
                        files.append((f"{root}/{uuid.uuid4().hex}", path))
                        out, now = store.open_output_stream(files[-1][0], compression=None), path
                    out.write((value + "\n").encode("utf-8"))
        finally:
            if out:
                out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        """All files get their names, or none does: two tasks with rows of one path are an error before any rename."""
        store, root = _place(self.work)
        files = [f for m in messages if m for f in m.files]
        finals = [f for _, f in files]
        if len(set(finals)) < len(finals):
            self.abort(messages)
            raise ValueError("rows of one path are in several tasks")
        for temporary, final in files:
            store.move(temporary, _place(final)[1])
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        store, root = _place(self.work)
        if store.get_file_info(root).type == fs.FileType.Directory:
            store.delete_dir(root)
