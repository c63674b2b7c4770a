"""Scalar column functions: casts, keys, residue codes, sequence text, content keys."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from protspark.schemas import AA3_TABLES, AMINO_ACIDS

MISSING_TEXT = ["", "null"]


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---- casts -------------------------------------------------------------------------------------

def tolerant_number(c: str | Column, to: str = "double") -> Column:
    """Number or null; whole-number targets go through double, so ``"2019.0"`` becomes 2019."""
    number = col(c).cast("string").try_cast("double")
    return number if to == "double" else number.try_cast(to)


def tolerant_cast(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Cast where possible. A value that will not parse stays readable in ``<col>_raw``.

    Spark columns have one type, so the unparsed text cannot stay in the column itself.
    """
    kept = df
    for name, to in types.items():
        number = tolerant_number(name, to)
        unparsed = F.col(name).isNotNull() & ~F.col(name).cast("string").isin(MISSING_TEXT) & number.isNull()
        kept = kept.withColumns({f"{name}_raw": F.when(unparsed, F.col(name).cast("string")), name: number})
    return kept


def strict_cast(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Cast or fail the job; blanks and ``null`` are passed through as null."""
    def one(name: str, to: str) -> Column:
        blank = F.col(name).cast("string").isin(MISSING_TEXT)
        value = F.when(~blank, F.col(name))
        number = value.cast("double")
        bad = value.isNotNull() & value.cast("string").try_cast("double").isNull()
        checked = F.when(bad, F.raise_error(F.concat(F.lit(f"{name} is not a number: "), value.cast("string"))).cast("double")).otherwise(number)
        return checked if to == "double" else checked.cast(to)

    return df.withColumns({n: one(n, t) for n, t in types.items()})


# ---- keys --------------------------------------------------------------------------------------

def require_key(df: DataFrame, key: str) -> DataFrame:
    return df.where(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))


def coalesce_nonempty(*cols: str | Column) -> Column:
    """First value that is neither null nor the empty string."""
    return F.coalesce(*[F.nullif(col(c).cast("string"), F.lit("")) for c in cols])


def _named(df: DataFrame, name: str, missing: str) -> Column:
    """The column's text, blank for null, or ``missing`` when the table has no such column."""
    return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in df.columns else F.lit(missing)


def default_key(df: DataFrame, kind: str) -> DataFrame:
    """Fill an empty key of an assay, toxicity or structure row from its other columns."""
    if kind == "assays":
        made = F.concat_ws(":", F.lit("assay"), *[_named(df, c, "NA") for c in ("uniprot_id", "ligand_id", "metric")])
        key = "assay_id"
    elif kind == "toxicity":
        made = F.concat_ws(":", F.lit("tox"), _named(df, "ligand_id", ""), _named(df, "flag", "unknown"))
        key = "tox_id"
    elif kind == "structures":
        partners = [c for c in ("ligand_id", "antibody_id", "peptide_id") if c in df.columns]
        partner = F.coalesce(coalesce_nonempty(*partners), F.lit("NA")) if partners else F.lit("NA")
        made = F.concat_ws(":", F.lit("structure"), _named(df, "uniprot_id", "NA"), partner)
        key = "structure_id"
    else:
        raise ValueError(f"no default key for {kind}")
    have = coalesce_nonempty(key) if key in df.columns else F.lit(None).cast("string")
    return df.withColumn(key, F.coalesce(have, made))


def file_stem(path: str | Column) -> Column:
    """File name up to its first dot."""
    return F.substring_index(F.substring_index(col(path), "/", -1), ".", 1)


def derive_pdb_id(structure_id: str | Column, path: str | Column) -> Column:
    sid = F.coalesce(col(structure_id), F.lit(""))
    prefixed = sid.startswith("pdb_") & (F.length(sid) > 4)
    return F.when(prefixed, F.regexp_replace(sid, "^pdb_", "")).otherwise(
        F.coalesce(file_stem(path), F.lit("")))


def content_key(*cols: str | Column) -> Column:
    """First 16 hex digits of SHA-1 over the columns joined with ``::``."""
    return F.substring(F.sha1(F.concat_ws("::", *[col(c) for c in cols]).cast("binary")), 1, 16)


# ---- residues and sequences ----------------------------------------------------------------------

def aa3_to_aa1(c: str | Column, table: str = "structure", default: str | None = "X") -> Column:
    """One-letter code of a three-letter residue name; unknown names give ``default``."""
    codes = AA3_TABLES[table]
    pairs = [F.lit(x) for kv in codes.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), F.upper(F.trim(col(c))))
    return F.coalesce(found, F.lit(default)) if default is not None else found


def normalize_seq(c: str | Column) -> Column:
    """Rare residues to X."""
    return F.regexp_replace(col(c), "[OBUZ]", "X")


def spaced_seq(c: str | Column) -> Column:
    spread = F.regexp_replace(col(c), "(?s)(.)", "$1 ")
    return F.substring(spread, F.lit(1), F.length(spread) - 1)


def letters_only(c: str | Column) -> Column:
    """Sequence of a FASTA text: header lines out, everything but A-Z out."""
    body = F.regexp_replace(F.trim(col(c)), "(?m)^>.*$", "")
    return F.regexp_replace(body, "[^A-Z]", "")


def parse_subject(c: str | Column) -> Column:
    """``struct(code, chain)`` of ids such as ``1abc_A``, or null."""
    pattern = "^([0-9][A-Za-z0-9]{3}|[0-9]{3}[A-Za-z])[_-]([A-Za-z0-9])$"
    code = F.regexp_extract(col(c), pattern, 1)
    chain = F.regexp_extract(col(c), pattern, 2)
    return F.when(code != "", F.struct(F.upper(code).alias("code"), F.upper(chain).alias("chain")))


def residue_uid(protein: str | Column, pos: str | Column) -> Column:
    return F.concat_ws(":", col(protein), col(pos).cast("string"))


def residue_label(chain: str | Column, resname: str | Column, resnum: str | Column) -> Column:
    return F.concat(col(chain), F.lit("-"), col(resname), col(resnum).cast("string"))


def parse_residue_label(c: str | Column) -> Column:
    pattern = r"^(.+)-([A-Z]+)(\d+)$"
    part = lambda k: F.nullif(F.regexp_extract(col(c), pattern, k), F.lit(""))
    return F.struct(part(1).alias("chain"), part(2).alias("resname"), part(3).cast("int").alias("resnum"))


def one_hot(c: str | Column, vocab: list[str], default: str | None = None) -> Column:
    """0/1 array over ``vocab``; values outside it act as ``default`` (or give all zeros)."""
    words = F.array(*[F.lit(v) for v in vocab])
    value = col(c)
    if default is not None:
        value = F.when(value.isin(vocab), value).otherwise(F.lit(default))
    return F.transform(words, lambda w: F.when(w == value, 1.0).otherwise(0.0))


def aa_one_hot(c: str | Column) -> Column:
    return one_hot(c, list(AMINO_ACIDS))


# ---- prompts -------------------------------------------------------------------------------------

_PLACEHOLDER = re.compile(r"\{\{([A-Za-z0-9_]+)\}\}")


def render_prompt(template: str, variables: dict[str, str | Column]) -> Column:
    """Fill ``{{name}}`` placeholders; the template is split once, the text is built by Spark."""
    pieces = _PLACEHOLDER.split(template)
    missing = sorted({n for n in pieces[1::2] if n not in variables})
    if missing:
        raise KeyError(f"no value for {missing}; given: {sorted(variables)}")
    parts = [F.lit(p) if k % 2 == 0 else F.coalesce(col(variables[p]).cast("string"), F.lit(""))
             for k, p in enumerate(pieces)]
    return F.concat(*parts)


def instruction_text(c: str | Column) -> Column:
    """Training prompt of a sequence; the backslash-n is two characters."""
    return F.concat(F.lit("Predict fitness for sequence: "), col(c), F.lit("\\nAnswer:"))


# ---- numbers -------------------------------------------------------------------------------------

def clip(c: str | Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(col(c), F.lit(float(lo))), F.lit(float(hi)))


def sigmoid(c: str | Column) -> Column:
    return 1 / (1 + F.exp(-col(c)))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
