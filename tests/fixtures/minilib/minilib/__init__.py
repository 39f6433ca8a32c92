from .core import Session, fetch
from .errors import ReadError
