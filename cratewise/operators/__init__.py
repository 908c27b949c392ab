"""DataFrame-in, DataFrame-out operators over tracks, reads, frames and edits."""
