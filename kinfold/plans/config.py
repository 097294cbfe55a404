"""Parameters of an inference run, and the command line of runs."""

from __future__ import annotations

import argparse
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Config:
    genomes: str = ""  # folder of FASTA files
    hits: str | None = None  # folder of tabular search results between recoded genes; without, the built-in search makes them
    evalue: float = 1e-5  # of the built-in search
    output: str = ""
    mode: str = "lrb"  # lrb, arb or ar
    weight: str = "nbs"  # nbs, bs or sim
    quality: str = "rber"  # mvp, rbcv, rber or cmp
    coefficient: float = 1.0
    overlap: int = 0  # genomes that children of an I node may share
    seed: int = 0
    sequences: bool = False  # write the sequences of each group, a folder for each
    gml: bool = False  # write network, hierarchy and the hierarchy with groups' names as GML
    resume: bool = False

    def __post_init__(self):
        for name, allowed in (("mode", ("lrb", "arb", "ar")), ("weight", ("nbs", "bs", "sim")), ("quality", ("mvp", "rbcv", "rber", "cmp"))):
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} is one of {', '.join(allowed)}")


def parse(argv: list[str] | None = None, cls: type = Config, description: str = "Orthogroups and ortholog pairs from genomes and search results."):
    """Parameters of a run; texts that are empty by default must be given."""
    p = argparse.ArgumentParser(description=description)
    for f in fields(cls):
        if f.type == "bool":
            p.add_argument(f"--{f.name}", action="store_true")
        else:
            p.add_argument(f"--{f.name}", type={"float": float, "int": int}.get(f.type, str), default=f.default, required=f.default == "")
    return cls(**vars(p.parse_args(argv)))
