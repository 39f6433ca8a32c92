from . import errors
from .errors import ReadError


class Adapter:
    def send(self, url, timeout=None):
        raise NotImplementedError


class HttpAdapter(Adapter):
    def __init__(self, retries=3):
        self.retries = retries

    def send(self, url, timeout=None):
        """Send it."""
        try:
            return open(url)
        except TimeoutError as e:
            raise ReadError(e)


class Session:
    def __init__(self):
        self.adapter = None

    def get(self, url, timeout=5, *, verify=True, **kwargs) -> "Adapter":
        err = errors.BaseError("x")
        if not url:
            raise err
        adapter = Adapter()
        return adapter.send(url, timeout=timeout)


def fetch(url, timeout=None):
    return Session().get(url, timeout)


def outer(url):
    return fetch(url)
