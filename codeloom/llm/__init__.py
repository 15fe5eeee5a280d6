"""Training-data operators: ten document-corpus jobs and the pipeline that chains five of them."""
