"""Quillstream: document conversion as dataflow over Spark DataFrames."""

__version__ = "0.2.0"
__all__ = ["__version__", "convert", "convert_files", "extract_metadata", "register_converter", "validate_input"]


def __getattr__(name: str):
    """The interface of ``quillstream.api``, imported when it is used."""
    if name in __all__:
        from quillstream import api

        return getattr(api, name)
    raise AttributeError(name)
