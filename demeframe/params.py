"""All options of the commands, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass

DOCUMENTED, REFERENCE = "documented", "reference"


@dataclass(frozen=True)
class Params:
    """``compat`` picks between published formulas and the established tool's line-by-line behaviour."""

    min_depth: int = 3
    max_depth: int = 255
    min_rms: int = 25
    min_snpq: int = 25
    min_mapq: int = 13
    min_baseq: int = 13
    illumina: bool = False
    window: int | None = None  # bases; the command line takes kilobases
    output: int = 0
    het_prior: float | None = None  # given: heterozygous calls are kept
    outgroup: str | None = None
    min_sites: int = 10
    min_site_frac: float | None = None  # of the window, for divergence between populations and the spectrum tests
    min_pop: float = 1.0
    min_snps: int = 10
    dist: str = "pdist"
    no_singletons: bool = False
    substitutions_only: bool = False
    variable_only: bool = False
    infinite_sites: bool = False  # only positions with two alleles at most
    exclude_flags: int = 4
    compat: str = DOCUMENTED

    def __post_init__(self) -> None:
        wrong = []
        if self.min_depth < 0 or self.max_depth < self.min_depth:
            wrong.append("depths have to be 0 <= min <= max")
        if self.window is not None and self.window < 1:
            wrong.append("a window has at least one base")
        if self.output not in (0, 1, 2):
            wrong.append("output is 0, 1 or 2")
        if self.dist not in ("pdist", "jc"):
            wrong.append("dist is pdist or jc")
        if self.compat not in (DOCUMENTED, REFERENCE):
            wrong.append("compat is documented or reference")
        if not 0 <= self.min_pop <= 1:
            wrong.append("min_pop is a proportion")
        if wrong:
            raise ValueError("; ".join(wrong))

    @property
    def reference(self) -> bool:
        return self.compat == REFERENCE
