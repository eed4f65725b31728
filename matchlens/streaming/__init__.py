"""Plays as a stream: new files of plays update the partial sums that all window statistics start from."""
