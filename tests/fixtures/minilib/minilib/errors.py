"""Errors."""


class BaseError(IOError):
    """Anything that goes wrong."""


class ReadError(BaseError):
    pass


class SlowWarning(BaseError, Warning):
    pass
