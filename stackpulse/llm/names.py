"""Names of helper columns."""


def spare(columns, *wanted: str) -> list[str]:
    """Names for helper columns, lengthened until no column has them."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
