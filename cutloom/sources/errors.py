"""Errors of whole jobs; errors of single rows are nulls or an error column."""


class CutloomError(Exception):
    pass


class UnsupportedFileFormat(CutloomError):
    pass


class NoResults(CutloomError):
    pass


class UnknownExtractor(CutloomError):
    pass
