from . import address, names, numeric, predicates, render, text, timefn

__all__ = ["address", "names", "numeric", "predicates", "render", "text", "timefn"]
