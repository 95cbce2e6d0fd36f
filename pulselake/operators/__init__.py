"""pulselake.operators"""
