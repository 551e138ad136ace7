"""Typed errors of the engine. Causes are chained with ``raise ... from``."""


class SearchError(Exception):
    """Base of all errors that the engine raises itself."""


class UnknownValue(SearchError):
    what = "value"

    def __init__(self, value: str):
        super().__init__(f"unrecognized {self.what}: {value!r}")
        self.value = value


class UnknownTitle(UnknownValue):
    what = "title kind"


class UnknownScorer(UnknownValue):
    what = "scorer name"


class UnknownNgramType(UnknownValue):
    what = "ngram type"


class UnknownSimilarity(UnknownValue):
    what = "similarity function"


class UnknownDirective(UnknownValue):
    what = "search directive"


class NumberError(SearchError):
    """A part of a query that should be a number isn't."""


class ConfigError(SearchError):
    """A setting that can't be used."""


class DataError(SearchError):
    """A data file that doesn't have the form it should."""


class VersionMismatch(SearchError):
    def __init__(self, expected: int, got: object):
        super().__init__(f"index version mismatch: expected {expected} but got {got}; build the index anew")
        self.expected, self.got = expected, got


class CorruptIndex(SearchError):
    """The index lacks something that building it would have written."""


class LinkError(SearchError):
    """Proposals that can't be carried out together."""
