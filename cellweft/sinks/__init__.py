"""Writers of text formats, matrices, graphs and reports."""
