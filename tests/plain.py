"""Plain forms that tests compare with."""


def distance(a, b):
    """Unit-cost edit distance, one row of the matrix at a time."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]
