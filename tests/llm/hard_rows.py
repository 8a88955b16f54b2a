"""Nulls, empty and blank texts, ties, repeated rows, a long text."""

LONG = "Sentence number one of many, told again. " * 3000
ROWS = [
    (1, "The cat sat on the mat. It was a good mat.\nAnd then it left.", "en", "a"),
    (2, "The cat sat on the mat. It was a good mat.\nAnd then it left.", "en", "a"),
    (2, "The cat sat on the mat. It was a good mat.\nAnd then it left.", "en", "a"),
    (3, None, None, None),
    (4, "", "en", None),
    (5, " \t\n ", "fr", "b"),
    (6, LONG, "en", "b"),
    (7, "Le chat est sur la table. token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\" et voilà", "fr", "c"),
    (None, "No id here; password=7602ad27cf5550de1c and 4785380592391141 too", "en", "c"),
    (9, "Ünï çödé 😀 words", "de", "b"),
]
