"""Office documents to tables, text and Markdown on Spark."""

from .options import Cleanup, HeadingConfig, RenderOptions

__version__ = "0.1.0"
__all__ = ["Cleanup", "HeadingConfig", "RenderOptions", "version"]


def version() -> str:
    return __version__
