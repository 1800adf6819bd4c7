"""Class statistics, balancing, geometric transforms, masks and features."""
