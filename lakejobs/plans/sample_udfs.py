# A user file for register_udfs; outputSchema is defined for it.
# ruff: noqa: F821

import pandas as pd


@outputSchema("word:chararray")
def helloworld():
    return "Hello, World"


@outputSchema("size:bigint")
def size(text: pd.Series) -> pd.Series:
    return text.str.len().astype("Int64")


@outputSchema("words:{word:(place:int, text:chararray, letters:[int])}")
def words(text):
    """A bag of tuples: each word with its place and how often it has the letters o and r."""
    if text is None:
        return None
    return [(i, w, {c: w.count(c) for c in "or" if c in w}) for i, w in enumerate(text.split(" "))]


@outputSchema("stays:{(user_id:long, visits:int, first:long, last:long)}")
class Stays:
    """The events of a user up to each purchase as one row, and what follows the last one."""

    def __init__(self):
        self.stay = None

    def eval(self, row):
        user, event = row["user_id"], row["event_id"]
        self.stay = (user, self.stay[1] + 1, self.stay[2], event) if self.stay else (user, 1, event, event)
        if row["event_type"] == "purchase":
            yield self.stay
            self.stay = None

    def terminate(self):
        if self.stay:
            yield self.stay


@outputSchema("spread:(n:long, total:long, least:long, most:long, odd:long)")
class Spread:
    """Number, sum, bounds and number of odd values; nulls do not count."""

    state_schema = "state:(n:long, total:long, least:long, most:long, odd:long)"

    def initial(self, rows):
        values = [v for (v,) in rows if v is not None]
        return (len(values), sum(values), min(values, default=None), max(values, default=None), sum(v % 2 for v in values))

    def intermediate(self, states):
        n, total, least, most, odd = zip(*states)
        return (sum(n), sum(total), min((x for x in least if x is not None), default=None), max((x for x in most if x is not None), default=None), sum(odd))

    def final(self, states):
        return self.intermediate(states)
