"""Electrode position tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Unit-sphere positions (x right, y nose, z up) of the 10-20 system.
SYSTEM_1020 = {
    "Fp1": (-0.309, 0.951, 0.000), "Fp2": (0.309, 0.951, 0.000),
    "F7": (-0.809, 0.588, 0.000), "F3": (-0.545, 0.809, 0.225), "Fz": (0.000, 0.891, 0.454), "F4": (0.545, 0.809, 0.225), "F8": (0.809, 0.588, 0.000),
    "T3": (-1.000, 0.000, 0.000), "C3": (-0.707, 0.000, 0.707), "Cz": (0.000, 0.000, 1.000), "C4": (0.707, 0.000, 0.707), "T4": (1.000, 0.000, 0.000),
    "T5": (-0.809, -0.588, 0.000), "P3": (-0.545, -0.809, 0.225), "Pz": (0.000, -0.891, 0.454), "P4": (0.545, -0.809, 0.225), "T6": (0.809, -0.588, 0.000),
    "O1": (-0.309, -0.951, 0.000), "O2": (0.309, -0.951, 0.000),
}

# What the 10-10 system adds to the 10-20 system.
EXTRA_1010 = {
    "Fpz": (0.000, 0.999, 0.000),
    "AF7": (-0.587, 0.809, 0.000), "AF3": (-0.309, 0.951, 0.050), "AFz": (0.000, 0.950, 0.100), "AF4": (0.309, 0.951, 0.050), "AF8": (0.587, 0.809, 0.000),
    "F1": (-0.272, 0.850, 0.340), "F2": (0.272, 0.850, 0.340), "F5": (-0.677, 0.700, 0.113), "F6": (0.677, 0.700, 0.113),
    "FC5": (-0.905, 0.294, 0.225), "FC3": (-0.626, 0.405, 0.550), "FC1": (-0.354, 0.446, 0.750), "FCz": (0.000, 0.450, 0.800), "FC2": (0.354, 0.446, 0.750), "FC4": (0.626, 0.405, 0.550), "FC6": (0.905, 0.294, 0.225),
    "C1": (-0.354, 0.000, 0.866), "C2": (0.354, 0.000, 0.866), "C5": (-0.905, 0.000, 0.354), "C6": (0.905, 0.000, 0.354),
    "CP5": (-0.905, -0.294, 0.225), "CP3": (-0.626, -0.405, 0.550), "CP1": (-0.354, -0.446, 0.750), "CPz": (0.000, -0.450, 0.800), "CP2": (0.354, -0.446, 0.750), "CP4": (0.626, -0.405, 0.550), "CP6": (0.905, -0.294, 0.225),
    "TP7": (-0.987, -0.156, 0.000), "TP8": (0.987, -0.156, 0.000),
    "P1": (-0.272, -0.850, 0.340), "P2": (0.272, -0.850, 0.340), "P5": (-0.677, -0.700, 0.113), "P6": (0.677, -0.700, 0.113), "P7": (-0.809, -0.588, 0.000), "P8": (0.809, -0.588, 0.000),
    "PO7": (-0.587, -0.809, 0.000), "PO3": (-0.309, -0.951, 0.050), "POz": (0.000, -0.950, 0.100), "PO4": (0.309, -0.951, 0.050), "PO8": (0.587, -0.809, 0.000),
    "Oz": (0.000, -0.999, 0.000),
    "M1": (-1.050, -0.156, -0.100), "M2": (1.050, -0.156, -0.100), "TP9": (-1.050, -0.250, -0.200), "TP10": (1.050, -0.250, -0.200),
}

# Positions of the forward model where channels carry none.
FORWARD_1020 = {
    "Fp1": (-0.31, 0.95, -0.03), "Fp2": (0.31, 0.95, -0.03),
    "F7": (-0.81, 0.59, -0.03), "F3": (-0.55, 0.67, 0.50), "Fz": (0.00, 0.72, 0.69), "F4": (0.55, 0.67, 0.50), "F8": (0.81, 0.59, -0.03),
    "T3": (-0.95, 0.00, 0.00), "C3": (-0.59, 0.00, 0.59), "Cz": (0.00, 0.00, 0.72), "C4": (0.59, 0.00, 0.59), "T4": (0.95, 0.00, 0.00),
    "T5": (-0.81, -0.59, -0.03), "P3": (-0.55, -0.67, 0.50), "Pz": (0.00, -0.72, 0.69), "P4": (0.55, -0.67, 0.50), "T6": (0.81, -0.59, -0.03),
    "O1": (-0.31, -0.95, -0.03), "O2": (0.31, -0.95, -0.03),
}

# Flat positions of scalp maps where channels carry none.
FLAT_1020 = {
    "Fp1": (-0.31, 0.85), "Fp2": (0.31, 0.85),
    "F7": (-0.81, 0.45), "F3": (-0.39, 0.45), "Fz": (0.00, 0.45), "F4": (0.39, 0.45), "F8": (0.81, 0.45),
    "T3": (-0.95, 0.00), "C3": (-0.45, 0.00), "Cz": (0.00, 0.00), "C4": (0.45, 0.00), "T4": (0.95, 0.00),
    "T5": (-0.81, -0.45), "P3": (-0.39, -0.45), "Pz": (0.00, -0.45), "P4": (0.39, -0.45), "T6": (0.81, -0.45),
    "O1": (-0.31, -0.85), "O2": (0.31, -0.85),
}

SYSTEM_1010 = SYSTEM_1020 | EXTRA_1010
# Newer names of temporal sites in the 64-channel montage.
ALIASES = {"T7": "T3", "T8": "T4", "P7": "T5", "P8": "T6"}
SYSTEM_64 = {**{a: SYSTEM_1010[b] for a, b in ALIASES.items()}, **SYSTEM_1010}  # positions there already win
SYSTEMS = {"10-20": SYSTEM_1020, "10-10": SYSTEM_1010, "biosemi64": SYSTEM_64}


def electrodes(spark: SparkSession, system: str = "10-20") -> DataFrame:
    if system not in SYSTEMS:
        raise ValueError(f"unknown system {system!r}; one of {', '.join(SYSTEMS)}")
    rows = [(system, k, *v) for k, v in SYSTEMS[system].items()]
    return spark.createDataFrame(rows, "system string, label string, pos_x double, pos_y double, pos_z double")
