"""Rows that every operator has to take."""

SF = "/root/testdata/sf0.001"
ODD = [
    (1, None), (2, ""), (3, " \n\t"), (4, "same text here"), (5, "same text here"), (5, "same text here"), (None, "same text here"),
    (6, "été " * 30_000), (7, "x" * 200_000), (8, "\x00\x85\xa0  odd"),
]
