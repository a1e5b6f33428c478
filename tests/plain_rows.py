"""What tests of the registered queries share."""

import os

import pandas as pd

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    """Comparable rows of a pandas frame, columns by name."""

    def plain(x):
        if pd.isna(x):
            return "null"
        if isinstance(x, (int, float)) and not isinstance(x, bool):
            return round(float(x), 6) + 0.0
        return str(x)

    return sorted((tuple(plain(x) for x in r) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False)), key=str)
