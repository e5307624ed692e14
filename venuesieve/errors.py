"""Errors raised on the driver. Row-level problems are columns, not exceptions."""


class ListingSchemaError(ValueError):
    """A raw listing table lacks columns of the contract and the check is strict."""


class CorpusTooSmallError(ValueError):
    """Fewer usable listings than the caller demands."""
