"""Masses, residues, reagents and thresholds that results depend on."""

# Monoisotopic masses (Da).
PROTON = 1.007276466771
WATER = 18.0105650638
HYDROGEN = 1.0078250319
NEUTRON_STEP = 1.00335
ISOTOPE_STEP = 1.0033548378

# Monoisotopic residue masses, I folded to L.
RESIDUES = {
    "G": 57.021463735, "A": 71.037113805, "S": 87.032028435, "P": 97.052763875, "V": 99.068413945,
    "T": 101.047678505, "C": 103.009184505, "L": 113.084064015, "N": 114.04292747, "D": 115.026943065,
    "Q": 128.05857754, "K": 128.09496305, "E": 129.042593135, "M": 131.040484645, "H": 137.058911875,
    "F": 147.068413945, "R": 156.10111105, "Y": 163.063328575, "W": 186.07931298,
}
CARBAMIDOMETHYL = 57.021464

# Tagging limits.
PEAK_CEILING = 1024
PEAK_WINDOW = 100.0
MAX_GAP_SPELLINGS = 8
PRECURSOR_SLACK = 1.5
ETD_REDUCED_ABOVE = 3.0
MAX_FRAGMENT_CHARGE = 8
FIDELITY_DRAWS = 10000


def residue_rows(fixed: dict[str, float] | None = None) -> list[tuple[str, float]]:
    """Residue letters with fixed shifts applied, lightest first."""
    fixed = fixed or {}
    return sorted(((r, m + fixed.get(r, 0.0)) for r, m in RESIDUES.items()), key=lambda t: t[1])

# Ion pairs. off_c is the C-terminal ion's neutral mass minus its residues, off_n the
# N-terminal one's; delta is added to the precursor mass in the complement test.
AMMONIA = 17.0265491015
ION_PAIRS = {
    "by": {"off_n": 0.0, "off_c": WATER, "delta": 0.0, "charge_loss": 0},
    "cz": {"off_n": AMMONIA, "off_c": WATER - (AMMONIA - HYDROGEN), "delta": HYDROGEN, "charge_loss": 1},
}
