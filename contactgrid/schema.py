"""Column types of the domain tables."""

from __future__ import annotations

#: A read pair.
PAIRS = (
    "strand1 boolean, chr1 string, pos1 int, frag1 int, mapq1 int, strand2 boolean, chr2 string, pos2 int, frag2 int, mapq2 int, "
    "score float, seq1 string, seq2 string"
)
#: A cell of a matrix: its chromosomes, unit, bin size and bins.
CONTACTS = "chr1 int, chr2 int, unit string, bin_size int, bin_x int, bin_y int, counts double"
#: A value of a normalization vector. A missing one is null.
NORM_VECTORS = "norm string, chr int, unit string, bin_size int, bin int, value double"
#: An expected value by distance.
EXPECTED = "norm string, unit string, bin_size int, dist int, value double"
#: A loop or domain.
FEATURES = "chr1 string, start1 long, end1 long, chr2 string, start2 long, end2 long, color string, attrs map<string,string>"
