"""DataFrame transforms: alignment, metrics, few-shot selection, prompts, corpus rows, rewards."""
