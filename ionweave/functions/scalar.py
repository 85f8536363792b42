"""Column functions on sequences, identifiers and masses (all built-in expressions)."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from ionweave.functions import constants as K


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def fold_residues(s) -> Column:
    """Upper-case letters only, I read as L, ambiguity codes as ``#``."""
    return F.translate(F.upper(F.regexp_replace(_c(s), "[^A-Za-z]+", "")), "IXBZJUO", "L######")


def base_sequence(tag) -> Column:
    """The residues of an annotated tag, without its bracketed names."""
    return F.regexp_replace(_c(tag), r"\[[^\]]*\]", "")


def residue_tokens(tag) -> Column:
    """One array entry per residue, a modified residue keeping its bracket."""
    return F.regexp_extract_all(_c(tag), F.lit(r"([A-Z](?:\[[^\]]*\])?)"), F.lit(1))


def _map(d: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def mod_shifts(tag, mods: dict[str, float]) -> Column:
    """Mass shift per residue; ``mods`` maps ``X[Name]`` to its delta."""
    table = _map(mods) if mods else None
    return F.transform(residue_tokens(tag), lambda t: F.coalesce(F.element_at(table, t), F.lit(0.0)) if mods else F.lit(0.0))


def residue_masses(seq, fixed: dict[str, float] | None = None) -> Column:
    """Array of residue masses of a plain sequence (NULL entry for an unknown letter)."""
    masses = dict(K.RESIDUES)
    masses["I"] = masses["L"]
    for r, d in (fixed or {}).items():
        masses[r] = masses[r] + d
    # by the letter's place from A on: a look-up in a map compares its keys one by one
    table = F.array(*[F.lit(masses.get(chr(65 + k))).cast("double") for k in range(26)])
    return F.transform(F.split(_c(seq), ""), lambda r: F.get(table, F.ascii(r) - 65))


def residue_sum(seq, fixed: dict[str, float] | None = None) -> Column:
    return F.aggregate(residue_masses(seq, fixed), F.lit(0.0), lambda a, x: a + x)


def peptide_mass(seq, fixed: dict[str, float] | None = None) -> Column:
    """Neutral monoisotopic mass of a plain peptide."""
    return residue_sum(seq, fixed) + F.lit(K.WATER)


def prefix_masses(seq, fixed: dict[str, float] | None = None) -> Column:
    """Residue mass before each position: n + 1 entries, the first 0."""
    zero = F.array(F.lit(0.0))
    return F.aggregate(residue_masses(seq, fixed), zero,
                       lambda acc, m: F.concat(acc, F.array(F.element_at(acc, -1) + m)))


def tolerance(mz, tol: float, ppm: bool) -> Column:
    """Half-width in Da at an m/z."""
    return _c(mz) * F.lit(tol * 1e-6) if ppm else F.lit(float(tol))


def neutral_mass(mz, charge) -> Column:
    return _c(mz) * _c(charge) - _c(charge) * F.lit(K.PROTON)


def complement_mz(mass, precursor_charge, z, mz, rule: str) -> Column:
    """Partner m/z of a fragment: ``same`` charge, or ``precursor`` (NULL without a partner)."""
    mass, c, z, mz = _c(mass), _c(precursor_charge), _c(z), _c(mz)
    if rule == "precursor":
        return F.when(z < c, (mass + c * F.lit(K.PROTON) - z * mz) / F.nullif(c - z, F.lit(0)))
    return mass / z + F.lit(2.0 * K.PROTON) - mz


def bare_endpoint(seq, first: bool) -> Column:
    """First or last residue when it carries no bracket, else the empty string."""
    if first:
        return F.regexp_extract(_c(seq), r"^([A-Z])(?!\[)", 1)
    return F.regexp_extract(_c(seq), r"([A-Z])$", 1)


def to_proforma(seq, nterm_mass, cterm_mass, fixed: dict[str, str] | None = None) -> Column:
    """Tag as ProForma: fixed rules first, flank masses in brackets when 0.5 Da or more, L written J."""
    rules = "".join(f"<[{name}]@{res}>" for res, name in (fixed or {}).items())
    body = F.array_join(F.transform(residue_tokens(seq), lambda t: F.concat(
        F.translate(F.substring(t, 1, 1), "L", "J"), F.substring(t, 2, 1000))), "")
    n = F.when(_c(nterm_mass) >= 0.5, F.format_string("[+%.4f]-", _c(nterm_mass))).otherwise("")
    c = F.when(_c(cterm_mass) >= 0.5, F.format_string("-[+%.4f]", _c(cterm_mass))).otherwise("")
    return F.concat(F.lit(rules), n, body, c)


def usi_index(native_id, position) -> Column:
    """Index part of a universal spectrum identifier from a native id and a 0-based position."""
    nid = _c(native_id)
    only_scan = F.regexp_extract(nid, r"^(?:.*\s)?scan=(\d+)$", 1)
    controller = nid.rlike(r"^controllerType=0 controllerNumber=1 scan=\d+$")
    keys = F.regexp_extract_all(nid, F.lit(r"(\w+)=\S+"), F.lit(1))
    numbers = F.regexp_extract_all(nid, F.lit(r"\w+=(\d+)"), F.lit(1))
    return (F.when(controller | (nid.rlike(r"^scan=\d+$")), F.concat(F.lit("scan:"), only_scan))
            .when((F.size(keys) > 0) & (F.size(keys) == F.size(numbers)),
                  F.concat(F.lit("nativeId:"), F.array_join(numbers, ",")))
            .otherwise(F.concat(F.lit("index:"), _c(position).cast("string"))))


def scan_of(spectrum_id) -> Column:
    """Scan number of an id: ``scan=N``, ``scan:N``, ``name.N.N.z`` or a plain number; else NULL."""
    s = _c(spectrum_id)
    found = [F.regexp_extract(s, p, 1) for p in (r"\bscan[=:](\d+)", r"\.0*(\d+)\.0*\d+\.\d+", r"^0*(\d+)$")]
    return F.coalesce(*[F.nullif(f, F.lit("")) for f in found]).cast("long")


def run_stem(path) -> Column:
    """File name without folders and without its known extensions."""
    name = F.regexp_extract(_c(path), r"([^/\\]*)$", 1)
    return F.regexp_replace(name, r"(?i)(\.(mzml|mgf|raw|d|mzpeak|parquet|tsv|csv))*(\.gz)?$", "")


def spectrum_key(spectrum_id) -> Column:
    """Join key of an id: its scan number when it has one, else the trimmed id."""
    return F.coalesce(scan_of(spectrum_id).cast("string"), F.trim(_c(spectrum_id)))


def mz_band(mz) -> Column:
    """0..3 for the bands starting at 0, 400, 800 and 1200 m/z (up to 2000), else NULL."""
    return F.when((_c(mz) >= 0) & (_c(mz) < 2000),
                  F.when(_c(mz) < 400, 0).when(_c(mz) < 800, 1).when(_c(mz) < 1200, 2).otherwise(3))


def mass_bin(mz) -> Column:
    """Nominal-mass bin with the averagine spacing of 1.0005079 Da."""
    return F.floor(_c(mz) / F.lit(1.0005079) + F.lit(0.5)).cast("int")


def normalize_peptide(p) -> Column:
    """Plain, I/L-folded peptide: flanking residues, brackets and other marks removed."""
    s = F.regexp_replace(_c(p), r"^[A-Z\-]\.(.*)\.[A-Z\-]$", "$1")
    s = F.regexp_replace(s, r"\[[^\]]*\]|\([^)]*\)", "")
    return F.translate(F.regexp_replace(F.upper(s), "[^A-Z]", ""), "I", "L")


def normalize_tag(t) -> Column:
    return F.translate(base_sequence(t), "I", "L")
