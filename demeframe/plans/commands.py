"""The commands as plans: reads or a pileup in, a long table out.

``prepare`` is the part they share: call, classify, reduce to sites.  It is lazy;
everything up to the sites is keyed by position, so it takes one exchange.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..operators import calls as C
from ..operators import diversity, haplotypes, linkage, snps, tree
from ..operators import sites as S
from ..operators.windows import Region, spine, with_window
from ..params import Params

COMMANDS = ("snp", "fasta", "haplo", "diverge", "tree", "nucdiv", "ld", "sfs")


@dataclass(frozen=True)
class Prepared:
    """``calls`` and ``sites`` of a region, its windows, populations and sample names."""

    calls: DataFrame
    sites: DataFrame
    spine: DataFrame
    pops: list[S.Pop]
    names: list[str]
    region: Region
    params: Params

    @property
    def outgroup(self) -> int | None:
        """The outgroup's sample id; an unknown name is an error."""
        if self.params.outgroup is None:
            return None
        if self.params.outgroup not in self.names:
            raise ValueError(f"no sample {self.params.outgroup!r}")
        return self.names.index(self.params.outgroup)

    @property
    def outgroup_pop(self) -> S.Pop | None:
        """The outgroup's population."""
        return None if self.outgroup is None else S.population_of(self.pops, self.outgroup)


def prepare(spark: SparkSession, pileup: DataFrame, ref_bases: DataFrame, pops: list[S.Pop], names: list[str], region: Region, p: Params) -> Prepared:
    inside = with_window(pileup, region, p).drop("win_id")
    called = C.classify(C.call(inside, p), ref_bases, p)
    called = S.infinite_sites(with_window(called, region, p), p)
    return Prepared(called, S.sites(called), spine(spark, region, p), pops, names, region, p)


def run(command: str, x: Prepared) -> DataFrame:
    """The command's long table."""
    a = (x.sites, x.pops, x.spine, x.params)
    o = x.params.output
    if command == "nucdiv":
        return diversity.nucleotide_diversity(*a)
    if command == "sfs":
        return diversity.spectrum(*a, x.outgroup)
    if command == "diverge":
        return diversity.divergence_population(*a, x.outgroup) if o else diversity.divergence_individual(*a)
    if command == "ld":
        return (linkage.zns, linkage.omega_max, linkage.wall)[o](*a)
    if command == "haplo":
        return (haplotypes.diversity, haplotypes.ehhs, haplotypes.gmin)[o](*a)
    if command == "tree":
        return tree.trees(*a, ["ref", *x.names])
    if command == "snp":
        if o == 0:
            return snps.table(x.calls, x.sites, x.pops, x.params)
        return snps.sweepfinder(x.sites, x.pops, x.params, x.outgroup) if o == 1 else snps.ms_blocks(x.sites, x.pops, x.spine, x.params, x.outgroup)
    if command == "fasta":
        return snps.fasta(x.calls, x.spine, x.pops)
    raise ValueError(f"no command {command!r}; there are {', '.join(COMMANDS)}")
