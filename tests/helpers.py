"""What several test modules share."""


def value_of(metrics, name, dimension="corpus", key=""):
    rows = metrics.filter(
        (metrics.name == name) & (metrics.dimension == dimension) & (metrics.key == key)
    ).collect()
    assert len(rows) <= 1, rows
    if not rows:
        return None
    return rows[0].value_long if rows[0].value_long is not None else rows[0].value_double
