"""Structure files as atom rows: fixed-width PDB through Spark's text reader, mmCIF through a tokenizer.

Many files are read in one job; ``structure_id`` is the file's name without folders and suffixes, or what another
``name`` makes of its path, such as ``whole_path`` where files of several folders are called alike.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .. import schema

PDB_SUFFIXES = ("pdb", "ent")
CIF_SUFFIXES = ("cif", "mmcif")
_SUFFIX = r"(\.(pdb|ent|cif|mmcif))+(\.gz)?$"


def structure_id(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), rf"(?i){_SUFFIX}", "")


def whole_path(path: Column) -> Column:
    return F.regexp_replace(path, "^file:/+", "/")


def naming(paths: Sequence[str]) -> Callable[[Column], Column]:
    """``structure_id`` where it tells all ``paths`` apart, else ``whole_path``."""
    stems = [re.sub(_SUFFIX, "", p.rpartition("/")[2], flags=re.IGNORECASE) for p in set(paths)]
    return structure_id if len(set(stems)) == len(stems) else whole_path


def _float(name: str) -> Column:
    """Coordinates are single precision in the data model: text to float, then to double."""
    return F.expr(f"cast(try_cast({name} AS float) AS double)")


def element_of(element: Column, atom_name: Column) -> Column:
    """The element in upper case; where blank, the letters of the atom name's first two columns, of which
    a leading blank or digit means a one-letter element."""
    two = F.upper(F.regexp_replace(F.substring(atom_name, 1, 2), r"[^A-Za-z]", ""))
    guess = F.when(F.regexp_like(F.substring(atom_name, 1, 1), F.lit(r"[ 0-9]")), F.substring(two, 1, 1)).when(F.length(F.trim(atom_name)) == 4, F.substring(two, 1, 1)).otherwise(two)
    return F.coalesce(F.nullif(F.upper(F.trim(element)), F.lit("")), guess)


def best_altloc(atoms: DataFrame) -> DataFrame:
    """One row per atom with alternative locations: that of the highest occupancy, the first of equal ones. Only these
    few rows are shuffled; an atom without a location mark stands for itself."""
    key = ["structure_id", "model", "chain", "resname", "resnum", "icode", "atom_name"]
    several = atoms.where("altloc <> ''").withColumn("__n", F.row_number().over(W.partitionBy(*key).orderBy(F.desc("occupancy"), "ordinal")))
    return atoms.where("altloc = ''").unionByName(several.where("__n = 1").drop("__n"))


def read_pdb(spark: SparkSession, paths: str | Sequence[str], altloc: bool = True, name: Callable[[Column], Column] = structure_id) -> DataFrame:
    """Atoms of PDB files (also gzipped), in the schema of ``schema.ATOM``; ``ordinal`` is the order in the
    file. Lines whose coordinates don't parse are left out. ``altloc``: resolve alternative locations."""
    text = spark.read.text(paths if isinstance(paths, str) else list(paths), wholetext=True).select(name(F.col("_metadata.file_path")).alias("structure_id"), F.split("value", r"(?m)^(?=MODEL )").alias("parts"))
    # a part for each model, so that its number needs no look at other rows
    lines = text.select("structure_id", F.posexplode("parts").alias("m", "part"))
    model = F.when(F.col("part").startswith("MODEL "), F.expr("try_cast(trim(substr(part, 7, 8)) as int)"))
    lines = lines.select("structure_id", (F.coalesce(model, F.lit(1)) - 1).alias("model"), "m", F.posexplode(F.split("part", r"\r?\n")).alias("n", "line"))
    lines = lines.where(F.substring("line", 1, 6).isin("ATOM  ", "HETATM"))
    cut = lambda a, n: F.substring("line", a, n)
    rows = lines.select(
        "structure_id", F.col("model").cast("int").alias("model"), F.trim(cut(22, 1)).alias("chain"),
        F.when(cut(1, 6) == "ATOM  ", " ").when(F.trim(cut(18, 3)).isin("HOH", "WAT"), "W").otherwise("H").alias("hetflag"),
        F.trim(cut(18, 3)).alias("resname"), F.expr("try_cast(trim(substr(line, 23, 4)) as int)").alias("resnum"), F.trim(cut(27, 1)).alias("icode"),
        F.trim(cut(13, 4)).alias("atom_name"), F.trim(cut(17, 1)).alias("altloc"), element_of(cut(77, 2), cut(13, 4)).alias("element"),
        _float("trim(substr(line, 31, 8))").alias("x"), _float("trim(substr(line, 39, 8))").alias("y"), _float("trim(substr(line, 47, 8))").alias("z"),
        F.coalesce(F.expr("try_cast(trim(substr(line, 55, 6)) as double)"), F.lit(1.0)).alias("occupancy"), (F.col("m").cast("long") * (1 << 32) + F.col("n")).alias("ordinal"),
    ).where("x is not null and y is not null and z is not null")
    return best_altloc(rows) if altloc else rows


def tokens(text: str) -> Iterator[str | None]:
    """CIF tokens: bare words, quoted strings and semicolon blocks; a bare ``.`` or ``?`` is null."""
    lines = iter(text.splitlines())
    for line in lines:
        if line.startswith(";"):
            block = [line[1:]]
            for more in lines:
                if more.startswith(";"):
                    break
                block.append(more)
            yield "\n".join(block)
            continue
        i, n = 0, len(line)
        while i < n:
            c = line[i]
            if c.isspace():
                i += 1
            elif c == "#":
                break
            elif c in "'\"":
                j = i + 1
                while j < n and not (line[j] == c and (j + 1 == n or line[j + 1].isspace())):
                    j += 1
                yield line[i + 1 : j]
                i = j + 1
            else:
                j = i
                while j < n and not line[j].isspace():
                    j += 1
                word = line[i:j]
                yield None if word in (".", "?") else word
                i = j


def atom_site(text: str) -> Iterator[dict[str, str | None]]:
    """Rows of the ``_atom_site`` loop of every block."""
    names: list[str] = []
    values: list[str | None] = []
    state = ""
    for t in tokens(text):
        low = t.lower() if t else ""
        if low == "loop_" or low.startswith("data_"):
            names, values, state = [], [], "head" if low == "loop_" else ""
        elif state == "head" and low.startswith("_"):
            names.append(low)
        elif state and low.startswith("_") and not values:
            names, state = [], ""
        elif state:
            if names and not names[0].startswith("_atom_site."):
                state = ""
                continue
            state = "rows"
            values.append(t)
            if len(values) == len(names):
                yield {n.removeprefix("_atom_site."): v for n, v in zip(names, values, strict=True)}
                values = []


def _cif(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fields = ["model", "chain", "group", "resname", "resnum", "icode", "atom_name", "altloc", "element", "x", "y", "z", "occupancy"]
    source = ["pdbx_pdb_model_num", "auth_asym_id", "group_pdb", "auth_comp_id", "auth_seq_id", "pdbx_pdb_ins_code", "auth_atom_id", "label_alt_id", "type_symbol", "cartn_x", "cartn_y", "cartn_z", "occupancy"]
    spare = {"auth_asym_id": "label_asym_id", "auth_comp_id": "label_comp_id", "auth_seq_id": "label_seq_id", "auth_atom_id": "label_atom_id"}
    for batch in batches:
        for name, text in zip(batch.column("structure_id").to_pylist(), batch.column("value").to_pylist(), strict=True):
            rows = [[r.get(s) or r.get(spare.get(s, s)) for s in source] for r in atom_site(text)]
            for a in range(0, len(rows), 20_000):
                part = rows[a : a + 20_000]
                cols = [pa.array([r[k] for r in part], pa.string()) for k in range(len(fields))]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(part), pa.string()), *cols, pa.array(range(a, a + len(part)), pa.int64())], names=["structure_id", *fields, "ordinal"])


def read_mmcif(spark: SparkSession, paths: str | Sequence[str], altloc: bool = True, name: Callable[[Column], Column] = structure_id) -> DataFrame:
    """Atoms of mmCIF files, named by the authors' identifiers. A file is one task's work: the format can't
    be split, since quoted blocks run over lines."""
    text = spark.read.text(paths if isinstance(paths, str) else list(paths), wholetext=True).select(name(F.col("_metadata.file_path")).alias("structure_id"), "value")
    return parse_mmcif(text, altloc)


def parse_mmcif(text: DataFrame, altloc: bool = True) -> DataFrame:
    """Atoms of ``text(structure_id, value)``, a row for each file."""
    strings = "model chain group resname resnum icode atom_name altloc element x y z occupancy".split()
    rows = text.mapInArrow(_cif, "structure_id string, " + ", ".join(f"{s} string" for s in strings) + ", ordinal long")
    blank = lambda c: F.coalesce(c, F.lit(""))
    rows = rows.select(
        "structure_id", (F.coalesce(F.expr("try_cast(model as int)"), F.lit(1)) - 1).alias("model"), blank(F.col("chain")).alias("chain"),
        F.when(F.col("group") == "ATOM", " ").when(F.col("resname").isin("HOH", "WAT"), "W").otherwise("H").alias("hetflag"),
        "resname", F.expr("try_cast(resnum as int)").alias("resnum"), blank(F.col("icode")).alias("icode"), "atom_name", blank(F.col("altloc")).alias("altloc"),
        element_of(blank(F.col("element")), F.col("atom_name")).alias("element"), _float("x").alias("x"), _float("y").alias("y"), _float("z").alias("z"),
        F.coalesce(F.expr("try_cast(occupancy as double)"), F.lit(1.0)).alias("occupancy"), "ordinal",
    ).where("x is not null and y is not null and z is not null")
    return best_altloc(rows) if altloc else rows


def read_structures(spark: SparkSession, paths: Sequence[str], strict: bool = False, name: Callable[[Column], Column] | None = None) -> DataFrame:
    """Atoms of files by suffix: PDB, else mmCIF. ``strict``: other suffixes are errors. Files are named by
    ``naming`` unless ``name`` is given."""
    name = name or naming(paths)
    suffix = lambda p: p.lower().removesuffix(".gz").rpartition(".")[2]
    if strict and (bad := [p for p in paths if suffix(p) not in PDB_SUFFIXES + CIF_SUFFIXES]):
        raise ValueError(f"unknown structure format: {bad[0]}")
    pdb = [p for p in paths if suffix(p) in PDB_SUFFIXES]
    cif = [p for p in paths if suffix(p) not in PDB_SUFFIXES]
    parts = ([read_pdb(spark, pdb, name=name)] if pdb else []) + ([read_mmcif(spark, cif, name=name)] if cif else [])
    if not parts:
        return spark.createDataFrame([], schema.ATOM)
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
