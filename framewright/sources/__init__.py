"""Reading and writing: tool logs, listings, snapshots, files, frames."""
